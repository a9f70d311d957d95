from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftgraph.llm import codefiles, leaks, matching, personal
from weftgraph.llm.boosting import Boosted
from weftgraph.llm.cutting import cut_items, pieces
from weftgraph.llm.grouping import components, consolidate
from weftgraph.llm.personal_seeds import GIVEN_NAMES, frames
from weftgraph.llm.tokens import DEFAULT_VOCABULARY, Encoder, encode_documents
from weftgraph.runtime import Workspace

LINKS = "canonical_entity_id string, matched_entities array<string>, confidence double, entity_id string, group_id string"


def brute_groups(data):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for c, m, *_ in data:
        ids = [x for x in [c, *(m or [])] if x is not None]
        for x in ids:
            a, b = sorted((find(ids[0]), find(x)))
            parent[b] = a
    return sorted((find(x), x) for x in parent)


def test_groups_equal_union_find(spark):
    r = random.Random(1)
    ids = [f"e{k}" for k in range(300)]
    data = [(r.choice([None, *ids]), r.choice([None, [], [r.choice([None, *ids]) for _ in range(r.randint(1, 3))]]), 0.5, "x", "y") for _ in range(160)]
    data += data[:20]
    assert rows(consolidate(spark.createDataFrame(data, LINKS))) == brute_groups(data)
    assert rows(consolidate(spark.createDataFrame([], LINKS))) == []
    assert rows(consolidate(spark.createDataFrame([(None, None, 0.1, "", ""), ("a", None, 0.1, "", ""), ("", ["", None], 0.1, "", "")], LINKS))) == [("", ""), ("a", "a")]


def test_long_chain_and_hub(spark):
    chain = [(f"c{k:04}", [f"c{k + 1:04}"], None, "", "") for k in range(400)]
    hub = [("hub", [f"h{k}"], None, "", "") for k in range(2000)]
    got = consolidate(spark.createDataFrame(chain + hub, LINKS)).groupBy("group_id").count()
    assert rows(got) == [("c0000", 401), ("h0", 2001)]


def test_components_stop(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    with pytest.raises(RuntimeError, match="rounds"):
        components(edges, Workspace(spark), max_rounds=0)


TEXTS = [
    "word " * 1000, "x" * 5001, ("A sentence here. " * 30 + "\n\n") * 9, "line of text\r\n" * 400, "🙂é" * 3000, "a\n" + "b" * 4000, "。".join("漢字" * 40 for _ in range(60)), " " * 2500, "short", "", None, "y" * 2000, "z" * 2001,
]


@pytest.mark.parametrize(("limit", "overlap"), [(2000, 200), (50, 0), (50, 49), (300, 40)])
def test_pieces_join_to_the_text(spark, limit, overlap):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string").select("k", "t", pieces(F.col("t"), limit, overlap).alias("p"))
    for r in df.collect():
        text, p = r["t"] or "", r["p"]
        assert all(0 < len(x) <= limit for x in p)
        joined = p[0] if p else ""
        for before, x in zip(p, p[1:]):
            shared = before[-overlap:] if overlap else ""
            assert x.startswith(shared) and len(x) > len(shared)
            joined += x[len(shared) :]
        assert joined == text and (len(p) <= 1) == (len(text) <= limit)


def test_pieces_end_at_boundaries(spark):
    df = spark.createDataFrame([(TEXTS[0],), (TEXTS[2],), (TEXTS[3],)], "t string").select(pieces(F.col("t")).alias("p"))
    words, paragraphs, lines = [r["p"] for r in df.collect()]
    assert all(x.endswith(" ") for x in words) and all(x.endswith("\n\n") for x in paragraphs) and all(x.endswith("\r\n") for x in lines)


def test_short_parts_and_sentences_without_blanks(spark):
    texts = ["a b c d e f g " + "x" * 60, "あい。" + "う" * 40, "w " * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(pieces(F.col("t"), 20, 6).alias("p")).collect()
    for t, r in zip(texts, got, strict=True):
        whole = r["p"][0]
        for a, b in zip(r["p"], r["p"][1:], strict=False):
            tail = a[-6:]
            assert b.startswith(tail) and len(b) <= 20
            whole += b[len(tail) :]
        assert whole == t
    assert got[1]["p"][0] == "あい。"


def test_cut_items(spark):
    s = "project_slug string, id string, text string, ordinal int, t string, p string, k0 string"
    data = [("p", "1", "a " * 1500, 7, "", "", ""), ("p", "1", "a " * 1500, 7, "", "", ""), ("p", "2", "short", 7, "", "", ""), ("p", "3", None, 7, "", "", ""), (None, None, "b" * 2001, 7, "", "", "")]
    got = cut_items(spark.createDataFrame(data, s), ["project_slug", "id"])
    assert rows(got, "id", "ordinal", "n_pieces") == [("1", 0, 2), ("1", 1, 2), (None, 0, 2), (None, 1, 2)]
    assert rows(cut_items(spark.createDataFrame([], s), ["id"])) == []


@pytest.fixture(scope="module")
def encoder():
    with open(DEFAULT_VOCABULARY, "rb") as f:
        return Encoder(f.read())


def test_tokens_equal_the_public_library(encoder, spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = DEFAULT_VOCABULARY.replace(".tiktoken", ".json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefgh  01é漢🙂\n\t'.,ﬁ\u200b") for _ in range(r.randint(1, 200))) for _ in range(400)]
    texts += ["aaaaaaaaaaaaab" * 200, "<|endoftext|>", " " * 999, "don't  stop\r\n", "", None, "\ud7ff", "ab" * 3000]
    df = spark.createDataFrame([(k, x, "z") for k, x in enumerate(texts)] * 2, "doc_id long, text string, ids string")
    got = encode_documents(df).collect()
    assert len(got) == 2 * len(texts)
    for row in got:
        text = texts[row["doc_id"]]
        assert list(row["ids"]) == (t.encode(text, add_special_tokens=False).ids if text else [])
    assert encode_documents(df.limit(0)).count() == 0


def test_token_round_trip(encoder):
    import base64

    tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(DEFAULT_VOCABULARY, "rb"))}
    r = random.Random(5)
    for _ in range(300):
        word = "".join(r.choice("tion ing th e r s 12 éü").strip() or " " for _ in range(r.randint(1, 30)))
        assert b"".join(tokens[i] for i in encoder.encode_word(word)) == word.encode()


PASSAGE = "The quick harbour crane lifted seven amber crates over the frozen quay while nobody in the old customs house noticed the missing ledger at all"


@pytest.mark.parametrize(
    ("text", "leaks_it"),
    [
        (PASSAGE, True), ("x. " + PASSAGE.upper().replace(" ", "\n") + " tail", True), (PASSAGE.replace("harbour", "har-\nbour").replace("crates", "**crates**"), True), (f"<p>{PASSAGE.replace(' ', '&nbsp;')}</p>", True),
        (" ".join(PASSAGE.split()[:12]), True), (" ".join(PASSAGE.split()[:11]), False), (" ".join(PASSAGE.split()[12:]) + ". " + " ".join(PASSAGE.split()[:12]), True),
        (" ".join(w if k % 8 else "zzz" for k, w in enumerate(PASSAGE.split(), 1)), True), (" ".join(w if k % 4 else "zzz" for k, w in enumerate(PASSAGE.split(), 1)), False), ("nothing of it", False), ("", False), (None, False),
    ],
)
def test_leaks(spark, text, leaks_it):
    docs = spark.createDataFrame([(1, text, 9)], "doc_id long, text string, words int")
    items = spark.createDataFrame([(5, PASSAGE, "q"), (6, None, "q"), (None, PASSAGE, "q"), (7, "too short a passage", "q"), (5, PASSAGE, "q")], "item_id long, passage string, question string")
    assert rows(leaks.find_leaks(docs, items), "doc_id", "item_id") == ([(1, 5)] if leaks_it else [])


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    items = spark.createDataFrame([(5, PASSAGE)], "item_id long, passage string")
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0 and leaks.find_leaks(docs.limit(0), items).count() == 0


def test_tiles_cover_reordered_runs():
    a = np.arange(1, 31)
    b = np.concatenate([a[20:], [0, 0], a[:20]])
    assert sum(n for _, _, n in leaks.tiles(a, b)) == 30
    r = random.Random(4)
    for _ in range(40):
        x, y = (np.array([r.randint(0, 6) for _ in range(40)]) for _ in range(2))
        seen_a, seen_b = np.zeros(40, bool), np.zeros(40, bool)
        for i, j, n in leaks.tiles(x, y):
            assert (x[i : i + n] == y[j : j + n]).all() and (x[i : i + n] > 0).all() and not seen_a[i : i + n].any() and not seen_b[j : j + n].any()
            seen_a[i : i + n] = seen_b[j : j + n] = True


ENTITY = "id string, project_slug string, type string, name string, normalized_name string, aliases array<string>, description string, metadata_json string, extraction_source string, ingested_at timestamp_ntz, names string, keys string"
ROLES = "router loader vault harvester journal monitor index indexer".split()


@pytest.mark.parametrize(
    ("a", "b", "least", "most"),
    [
        ("Blorgan Router", "blorgan_router", 1, 1), ("Blorgan Router", "BlorganRouter", 1, 1), ("Blorgan Router", "Router (Blorgan)", 1, 1), ("Blorgan Router", "the Blörgan Router service", 1, 1), ("Blorgan Router", "Blorganrouter", 1, 1),
        ("Blorgan Router", "Blorgan rtr", 0.85, 0.95), ("Blorgan Router", "Blrogan Router", 0.8, 0.8), ("Blorgan Router", "Bolrgon Router", 0.64, 0.64), ("Blorgan Router", "Blor. Router", 0.6, 0.6), ("Blorgan Router [12]", "Blor gan Router", 1, 1), ("Blorganroutervault", "Blorgan rout vau", 0.6, 0.6),
        ("Blorgan Journal", "Blorgan logbook", 0.3, 0.5), ("Blorgan Router", "Blorgan Loader", 0.3, 0.5), ("Blorgan Index", "Blorgan Indexer", 0.5, 0.75), ("Blorgan Router V2", "Blorgan Router V3", -1, -1), ("Blorgan Router", "Blorgan Router EU", -1, -1), ("Blorgan Router", "Takemi Router", 0, 0), ("BR", "Blorgan Router", 0.45, 0.45), ("BX", "Blorgan Router", 0, 0),
    ],
)
def test_names(a, b, least, most):
    x, y = matching.parse(a), matching.parse(b)
    assert least <= matching.similarity(x, y) <= most and matching.similarity(x, y) == matching.similarity(y, x)


def entity(k, name, source="graphify", type="System", meta=None, aliases=None, project="p", said=None):
    return (k, project, type, name, None, aliases, said, meta, source, None, "", "")


def matched(spark, data, **options):
    found = matching.match_entities(spark.createDataFrame(data, ENTITY), **options)
    return {(r["id_a"], r["id_b"]): r["confidence"] for r in found.collect()}


def test_matching(spark):
    e = entity
    data = [e(f"f{k}", f"Filler{k} {r.title()}") for k, r in enumerate(sorted(ROLES) * 3)]
    data += [
        e("a", "Blorgan Router", meta='{"port": 1000, "owner": "team-x"}'), e("b", "blorgan.router", "document_ingest", meta='{"port": 1000}'), e("c", "Blrogan Router", "local_fallback"), e("d", "Blorgan Router V2", "local_fallback"), e("d2", "Blorgan Router", "graphify"),
        e("g", "oe:0123456789abcdef", "local_fallback", aliases=["Takemi Vault", None]), e("h", "TakemiVault", meta="not json"), e("i", None, "document_ingest"), e("j", "Takemi Vault", "document_ingest", type="Class"), e("k", "Takemi Vault", "document_ingest", project="q"), e("l", "Takemi Vault", None),
    ]
    pairs = matched(spark, data + data[-3:])
    assert set(pairs) == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d2"), ("c", "d2"), ("g", "h")} and all(0.5 <= c <= 1 for c in pairs.values())
    assert matched(spark, []) == {}


def test_records_that_say_the_same_are_one_class(spark):
    data = [entity(f"{s[0]}{k}", "Blorgan Router", s) for s in ("graphify", "document_ingest", "local_fallback") for k in range(5)]
    assert len(matched(spark, data)) == 75


def test_transitivity_decides_a_doubtful_pair(spark):
    """``logbook`` and ``journal`` share no letters; the record between them joins both."""
    port, owner = '{"port": 4711, "owner": "Night Crew"}', '{"port": 4711, "owner": "team-night-crew", "since": "2020-01"}'
    data = [entity("a", "Blorgan logbook", "graphify", meta=port), entity("b", "Blorgan Journal", "document_ingest", meta=owner, aliases=["Blorgan logbook"]), entity("c", "Blorgan Journal", "local_fallback", meta='{"since": "2020-01", "owner": "Night Crew"}')]
    alone, solved = matched(spark, data, solve=False), matched(spark, data)
    assert ("a", "c") not in alone and set(solved) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_exclusivity_decides_between_rivals(spark):
    """Both records of the one source are near enough; the better of them takes the place."""
    meta = '{"port": 4711, "since": "2020-01"}'
    data = [entity("a", "Blorgandi Router", "graphify", meta=meta), entity("b", "Blorgandi Router", "document_ingest", meta=meta), entity("c", "Bolrgandy Router", "document_ingest")]
    alone, solved = matched(spark, data, solve=False), matched(spark, data)
    assert ("a", "c") in alone and set(solved) == {("a", "b")} and solved["a", "b"] > 0.6


def test_alternation_reaches_the_optimum(spark):
    """The values equal those of plain gradient descent on the whole problem."""
    r = random.Random(3)
    ids = [(f"{s}{k}", s) for s in "xyz" for k in range(3)]
    pairs = [(a, b, sa, sb, r.uniform(0.5, 5), r.uniform(0.5, 3)) for a, sa in ids for b, sb in ids if sa < sb]
    df = spark.createDataFrame(pairs, "a string, b string, sa string, sb string, up double, down double").withColumn("z", F.expr("up / (up + down)"))
    space = Workspace(spark)
    solved = matching._alternate(space.cut(df), space, 200, 10.0, 1e-4)
    rules: dict[str, list] = {}
    z = {p[:2]: p[4] / (p[4] + p[5]) for p in pairs}
    for _ in range(3):  # rules as the solver grounds them: at what they violate
        now = spark.createDataFrame([(*p[:4], *p[4:], z[p[:2]]) for p in pairs], "a string, b string, sa string, sb string, up double, down double, z double")
        for t in matching._ground(now).collect():
            rules.setdefault(t["rule"], set()).add((t["a"], t["b"], t["sign"], t["weight"]))
        for _ in range(3000):
            slope = {p[:2]: -2 * p[4] * (1 - z[p[:2]]) + 2 * p[5] * z[p[:2]] for p in pairs}
            for terms in rules.values():
                over = sum(s * z[a, b] for a, b, s, _ in terms) - 1
                for a, b, s, w in terms if over > 0 else ():
                    slope[a, b] += 2 * w * over * s
            z = {k: min(1.0, max(0.0, v - 0.004 * slope[k])) for k, v in z.items()}
    assert rules and all(abs(row["z"] - z[row["a"], row["b"]]) < 0.02 for row in solved.collect())


def test_near_spellings_cover_all_accepted_words():
    r = random.Random(11)

    def edit(s):
        k = r.randrange(len(s))
        return r.choice([s[:k] + s[k + 1 :], s[:k] + r.choice("abcd") + s[k:], s[:k] + r.choice("abcd") + s[k + 1 :], s[:k] + s[k + 1 : k + 2] + s[k] + s[k + 2 :]])

    for _ in range(3000):
        a = "".join(r.choice("abcd") for _ in range(r.choice([*range(5, 12), *range(23, 30)])))
        b = edit(edit(a))
        if matching._first_word(a, b) > matching.SHORTENED and min(len(a), len(b)) >= 5:
            assert matching.near_spellings(a) & matching.near_spellings(b), (a, b)


def test_two_typos_without_a_bridge(spark):
    data = [entity("a", "detrefaakol indexer", "graphify", meta='{"port": 7, "owner": "team-x", "since": "2024-01"}'), entity("b", "dterefakol indexer", "document_ingest", meta='{"owner": "team-x", "since": "2024-01"}')]
    assert set(matched(spark, data)) == {("a", "b")}


def test_matching_sends_no_table_through_the_driver(spark):
    """A broadcast gathers a side on the driver and takes 64 MB of its memory at least, whatever the table."""
    done = spark._jsparkSession.sharedState().statusStore()
    before = done.executionsCount()
    names = ["Blorgan Router", "blorgan.router", "Blrogan Router", "Blorgan logbook", "Takemi Vault", "TakemiVault"]
    data = [entity(f"{s[0]}{k}", n, s, meta='{"port": 4711}') for s in ("graphify", "document_ingest", "local_fallback") for k, n in enumerate(names)]
    assert matched(spark, data)
    after = done.executionsCount()
    plans = [done.executionsList(k, 1).head().physicalPlanDescription() for k in range(before, after)]
    assert len(plans) > 8 and any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_tidy_workspace_deletes_what_it_shuffled(spark):
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = set(shuffles.keySet().mkString(",").split(","))
    cut = Workspace(spark, tidy=True).cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert set(shuffles.keySet().mkString(",").split(",")) <= before | {""} and cut.count() == 7


def code(spark, *files):
    s = spark.createDataFrame([("p", f"S{k}", path, "repo_file") for k, (path, _) in enumerate(files)] + [("p", None, "x/vendor/y.py", "repo_file"), ("p", "doc", "a/vendor/b.md", "document")], "project_slug string, id string, path string, source_type string")
    sp = spark.createDataFrame([("p", f"{k}-{n}", f" s{k} ", n, t) for k, (_, texts) in enumerate(files) for n, t in enumerate(texts)] * 2 + [("p", None, None, 0, "x"), ("p", "z", "s0", 0, None)], "project_slug string, id string, source_id string, chars int, text string")
    return s, sp


HAND = "import json\n\n\ndef load(path):\n    with open(path) as f:\n        return json.load(f)\n"


@pytest.mark.parametrize(
    ("path", "texts", "kind"),
    [
        ("a/b.py", [HAND], None), ("a/b.py", ["# Code generated by tool 3. DO NOT EDIT.\n" + HAND], "generated"), ("a/b.py", ["# Copyright us\n# @generated from x\n", HAND], "generated"),
        ("a/b.py", ["# This module generates code and is itself written by hand.\n" + HAND], None), ("a/b.py", [HAND + 'HEADER = "# Code generated by us. DO NOT EDIT."\n'], None), ("a/node_modules/x/y.js", [HAND], "vendored"), ("external_partners/y.js", [HAND], None),
        ("a/b.go", ["// Copied from foo 1.2 upstream, local changes: none\n" + HAND], "vendored"), ("w/app.js", ["!function(u){for(var j=0;j<u.length;j++)u[j].j(q)}(this);" * 30], "minified"), ("w/app.js", ["// " + "some words of prose " * 40 + "\n" + HAND], None),
        ("a/b.ts", ["".join(f'export const A{k} = make("x{k}", {k});\n' for k in range(30))], "generated"), ("a/b.sql", ["-- note\n" * 4 + "-- built by hand, do not edit the order of these steps\nselect 1\n"], None), ("a/b.sql", ["-- x\n" * 400 + "-- Do not edit!\nselect 1\n"], "generated"), ("a/t.py", ["T = [\n" + "  [0.123, 0.456, 0.789],\n" * 40 + "]\n"], "data"), ("a/t.ts", ['export const x = "' + "QUJDREVGR0g+" * 60 + '"'], "data"), ("a/b_pb2.py", [HAND], "generated"), ("a/empty.py", [], None), ("a/b.py", [""], None),
    ],
)
def test_code_files(spark, path, texts, kind):
    got = codefiles.code_files(*code(spark, (path, texts)))
    assert rows(got, "id", "kind") == ([("S0", kind)] if kind else [])


def test_code_files_by_layout_alone(spark):
    got = codefiles.code_files(*code(spark, ("a/vendor/x.py", [HAND]), ("a/y.js", ["!function(u){for(var j=0;j<u.length;j++)u[j].j(q)}(this);" * 30])), marks=False)
    assert rows(got, "id", "kind") == [("S1", "minified")]


def test_pointing_entities(spark):
    s, sp = code(spark, ("a/vendor/x.py", [HAND]), ("a/y.py", [HAND]))
    e = spark.createDataFrame([("p", "1", "./a\\vendor\\x.py#L3"), ("p", "2", "a/y.py"), ("q", "3", "a/vendor/x.py"), ("p", "4", None), ("p", "1", "a/vendor//x.py")], "project_slug string, id string, source_path string")
    assert rows(codefiles.pointing_entities(e, codefiles.code_files(s, sp)), "id") == [("1",)]


@pytest.fixture(scope="module")
def fitted():
    return personal.fit_detector()


def test_no_frame_is_taken_from_the_corpus():
    """No fragment of twelve characters or more of the labelled sample occurs in the documents."""
    folder = "/root/testdata/sf0.1"
    if not os.path.exists(f"{folder}/documents.parquet"):
        pytest.skip("no corpus here")
    import pyarrow.parquet as pq

    corpus = "\n".join(t for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist() if t).lower()
    fragments = {part.strip() for f in frames() for part in re.split(r"<\w+>|\n|\t", f)}
    assert [x for x in fragments if len(x) >= 12 and x.lower() in corpus] == []


_GIVEN = "Bartholomew Thandeka Siobhan Rashid Aoife Ludmila Tarquin Ebba Nadezhda Kwabena Ismael Oluwaseun Marguerite Fergus Takumi Anneliese Radovan Svenja Amadou Yolanda Gwendolyn Hakim Lourdes Caspian Ottoline Zdenka".split()
_FAMILY = "Quigley Mbeki Halvorsen Karimi Okonkwo Hrabova Featherstone Lindqvist Castellanos Abubakar Vandermeer Brzezicki Tamura Oyelaran Delacroix Pfeiffer Grigoryan Winterbourne Sorensen Kapoor".split()
_SENTENCES = ("The draft was written by {}.", "Ms {} left early.", "Dr. {} sent the results.", "approver: {}", "{}: fine with me", "Yesterday {} fixed the roof.", "I spoke with {} on Friday.", "Frau {} kommt heute nicht.", "Merci à {} pour tout.", '"reviewer": "{}",', "| editor | {} | yes |", "A note from {} arrived.", "Regards,\n{}")


def test_personal_names_outside_any_list(fitted):
    assert not {*_GIVEN, *_FAMILY} & set(GIVEN_NAMES)
    texts = [(f"{g} {f}", _SENTENCES[k % len(_SENTENCES)].format(f"{g} {f}")) for k, (g, f) in enumerate((g, f) for g in _GIVEN for f in _FAMILY)][:500]
    found = personal.spans([t for _, t in texts], fitted)
    hit = sum(any(k == "person_name" and t[s:e] == name for s, e, k in f) for (name, t), f in zip(texts, found, strict=True))
    extra = sum(any(k != "person_name" or t[s:e] != name for s, e, k in f) for (name, t), f in zip(texts, found, strict=True))
    assert hit >= 450 and extra <= 25


def test_personal_held_out_values(fitted):
    cases = [
        ("My direct line is {}.", "phone", ["+1 202 555 0143", "(0711) 998 233", "06 12 34 56 78", "0161 496 0345"]), ("hotline: {}", "phone", ["+44 1632 960 983", "555-867-5309", "0049 89 636 48018"]),
        ("Passport {} was stolen.", "identity_number", ["AB1234567", "123-45-6789", "12345678Z"]), ("national insurance number: {}", "identity_number", ["JK 12 34 56 C", "98 765 432 109"]),
        ("We moved to {}.", "street_address", ["221 Maple Street, Springfield", "14 rue Victor, 75004 Paris", "Lindenstraße 9, 10969 Berlin", "Calle Mayor 5, 28013 Madrid"]),
        ("Contact {} for access.", "email", ["jo.bloggs@mail.example.com", "info(at)firma.de", "ann_b @ school.edu", "X-Y+z@a-b.co.uk"]),
    ]
    made = [(frame.format(v), v, kind) for frame, kind, values in cases for v in values]
    right = sum([(t[s:e], k) for s, e, k in found] == [(v, kind)] for (t, v, kind), found in zip(made, personal.spans([t for t, _, _ in made], fitted), strict=True))
    assert right >= 0.9 * len(made)


def test_personal_thresholds_are_calibrated(fitted):
    p, y = np.array([0.1, 0.3, 0.35, 0.6, 0.9]), np.array([0, 0, 1, 1, 1.0])
    assert 0.3 < personal._calibrated(p, y) <= 0.35
    assert set(fitted.thresholds) == set(personal.KINDS) and all(0.2 <= t <= 0.8 for t in fitted.thresholds.values())


def test_personal_unlike_names(fitted):
    for text in ("The delay is due to Fodazil Router.", "Thanks to Graph Core, it works.", "The Park Avenue cluster fails.", "According to the second run, it works.", "Der Dienst Libilize Balancer läuft.", "Unlike Nitofodor Mirror, it stays.", "Put @cache.memoize above it and pin tool@3.2.1."):
        assert personal.spans([text], fitted)[0] == []


def test_long_values_are_not_cut(fitted):
    email = "a" * 300 + "." + "b" * 200 + "@" + "c" * 60 + "." + "d" * 60 + ".example.org"
    road = "12 Llanfairpwllgwyngyllgogerychwyrndrobwll Upper Crescent, Apt 14B, Gorsafawddachaidraigodanheddogleddolon 20841"
    for value, kind in ((email, "email"), (road, "street_address")):
        text = f"Address: {value}\n"
        assert [(text[s:e], k) for s, e, k in personal.spans([text], fitted)[0]] == [(value, kind)]


def test_personal_redaction(spark):
    text = "Write to ruth.tose@example.org or call +44 20 7946 0056.\r\nThe clerk typed QQ 07 51 10 C into the SSN field. She moved to 12 Baker Street, Pevoton in spring.\nSigned off by Hugo von Tose. Firmware 01.99.00.13 and schema 020-7986 are obsolete."
    df = spark.createDataFrame([(1, text, "v"), (2, None, "v"), (3, "", "v"), (None, "x", "v"), (1, text, "v")], "doc_id long, text string, value string")
    got = personal.find_personal(df)
    assert got.count() == 5
    one = got.where("doc_id = 1").first()
    assert one["text"] == "Write to [EMAIL] or call [PHONE].\r\nThe clerk typed [IDENTITY_NUMBER] into the SSN field. She moved to [STREET_ADDRESS] in spring.\nSigned off by [PERSON_NAME]. Firmware 01.99.00.13 and schema 020-7986 are obsolete."
    assert [f["value"] for f in one["found"]] == ["ruth.tose@example.org", "+44 20 7946 0056", "QQ 07 51 10 C", "12 Baker Street, Pevoton", "Hugo von Tose"]
    assert rows(got.where("doc_id > 1"), "doc_id", "text") == [(2, None), (3, "")]
    assert personal.find_personal(df.limit(0)).count() == 0


def test_long_and_odd_texts(fitted):
    for text in ("a" * 300_000, "1 " * 100_000, "@" * 5000, "(" * 5000 + "1", "\x00\ud7ff Ruth", "Ruth " * 20_000, "+" + "1-" * 4000):
        for s, e, _ in personal.spans([text], fitted)[0]:
            assert text[s:e]


def test_boosting_learns_and_is_bounded():
    r = np.random.default_rng(0)
    x = r.random((600, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.3)).astype(float)
    m = Boosted().fit(x[:400], y[:400])
    assert ((m.probability(x[400:]) > 0.5) == y[400:]).mean() > 0.95
    with pytest.raises(ValueError, match="bounded"):
        Boosted(rows=10).fit(x, y)

"""Driver-side planning of questions: bounded decisions over a few hundred rows at most."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.edges import path_count, path_rank, signatures
from weftgraph.operators.retrieval import exact_lookup

# Words that steer the plan.
RANK_WORDS = re.compile(r"\b(most|least|highest|lowest|top|rank|fewest|more|fewer|largest|smallest)\b", re.IGNORECASE)
LOWEST_WORDS = re.compile(r"\b(least|lowest|fewest|smallest|fewer)\b", re.IGNORECASE)
COUNT_WORDS = re.compile(r"\b(how many|count|number of)\b", re.IGNORECASE)
ANALYTICAL_WORDS = re.compile(r"\b(most|least|highest|lowest|top|rank|fewest|more|fewer|largest|smallest|how many|count|number of|average|sum|total|maximum|minimum)\b", re.IGNORECASE)
INCOMING_WORDS = re.compile(r"\b(what|which|who)\b.*\b(depends on|uses|calls|reads|owns|produces)\b", re.IGNORECASE)
STOPWORDS = set("what which who when where why how does do did is are was were the a an of for to in on by with and or has have had its it many much most least show list tell me about between from".split())


def token_set(text: str) -> set[str]:
    """Words, split at capitals, lower, without one trailing s, then ed or er if longer than four."""
    out = set()
    for w in re.findall(r"[A-Za-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text)):
        w = w.lower().removesuffix("s")
        if len(w) > 4 and w.endswith(("ed", "er")):
            w = w[:-2]
        out.add(w)
    return out


def operation(question: str) -> str | None:
    """rank, count, or None: the question isn't for the planner."""
    if not ANALYTICAL_WORDS.search(question):
        return None
    return "rank" if RANK_WORDS.search(question) else "count" if COUNT_WORDS.search(question) else None


def name_candidates(question: str) -> list[str]:
    """Names a question may be about: runs of words that begin with a capital or digit, longest first."""
    words = re.findall(r"[\w.-]+", question)
    runs: list[list[str]] = [[]]
    for k, w in enumerate(words):
        w = w.strip(".-")
        if w and (w[0].isupper() or w[0].isdigit()) and w.lower() not in STOPWORDS and not (k == 0 and w.lower() in STOPWORDS):
            runs[-1].append(w)
        elif runs[-1]:
            runs.append([])
    grams = [" ".join(r[i:j]) for r in runs for i in range(len(r)) for j in range(i + 1, len(r) + 1)]
    return list(dict.fromkeys(sorted(grams, key=lambda g: -len(g.split()))))


def predicate_terms(question: str, limit: int = 8) -> list[str]:
    words = [w.lower() for w in re.findall(r"[A-Za-z]+", question) if w[0].islower()]
    return list(dict.fromkeys(w.removesuffix("s") for w in words if len(w) >= 3 and w not in STOPWORDS))[:limit]


def direction(question: str) -> str:
    return "incoming" if INCOMING_WORDS.search(question) else "outgoing"


def score_signature(signature: dict, question: str, op: str) -> float:
    """How well a kind of path suits a question; -inf if it can't answer it."""
    if op == "rank" and not signature["intermediate_types"]:
        return -math.inf
    asked = token_set(question)
    group = token_set(signature["group_type"] or "")
    middle = [token_set(t or "") for t in signature["intermediate_types"]]
    vocabulary = set().union(group, *middle, *[token_set(p) for p in signature["predicates"]])
    after = re.search(r"\b(?:most|least|more|fewest|highest|lowest)\s+(\w+)", question, re.IGNORECASE)
    metric = token_set(after[1]) if after else set()
    score = 4 * len(asked & vocabulary) + 8 * len(asked & group) + math.log1p(signature["examples"]) - 4 * signature["hops"]
    if middle:
        score += 3 * max(len(asked & m) for m in middle) + 12 * max(len(metric & m) for m in middle)
    score -= 10 * len(metric & group)
    if middle and any(m == group for m in middle) and asked & group:
        score -= 8
    return score


@dataclass
class Answer:
    kind: str
    text: str
    rows: list[dict] = field(default_factory=list)
    citations: list[str] = field(default_factory=list)


class Generator(Protocol):
    """Writes an answer from contexts; ours is a stub, a model may be plugged in."""

    def answer(self, question: str, contexts: Sequence[dict]) -> str: ...


def metric_type(signature: dict, question: str) -> str:
    """Of the types between, the one the question's words name most; the first if none does."""
    after = re.search(r"\b(?:most|least|more|fewest|highest|lowest)\s+(\w+)", question, re.IGNORECASE)
    asked, metric = token_set(question), token_set(after[1]) if after else set()
    middle = signature["intermediate_types"]
    return max(middle, key=lambda t: (len(metric & token_set(t or "")), len(asked & token_set(t or "")), -middle.index(t)))


def analytics(question: str, entities: DataFrame, edges: DataFrame, limit: int = 100) -> Answer | None:
    """Rank or count answered by the best kind of path, of up to three hops, from the entity the question names.

    Paths are undirected.  A rank counts the distinct nodes of the metric type between a
    candidate and the named entity; a count is that of the distinct candidates themselves.
    """
    op = operation(question)
    names = name_candidates(question)
    if op is None or not names:
        return None
    found = exact_lookup(entities, names, 1).orderBy("project_slug", "id").limit(8).collect()  # eight entities at most
    if not found:
        return None
    start = edges.sparkSession.createDataFrame([(r["project_slug"], r["id"]) for r in found], "project_slug string, a string")
    rows = [r.asDict() for r in signatures(edges, start, hops=3).collect()]  # 200 at most
    usable = [(score_signature(s, question, op), str(s), s) for s in rows]
    usable = [x for x in usable if x[0] > -math.inf]
    if not usable:
        return None
    best = max(usable)[2]
    if op == "count":
        counted = [r.asDict() for r in path_count(edges, best["predicates"], best["group_type"], start).orderBy("project_slug", "filter").collect()]  # eight at most
        return Answer(op, f"There are {sum(r['value'] for r in counted)}.", counted, [r["filter"] for r in counted]) if counted else None
    ranked = path_rank(edges, best["predicates"], best["group_type"], metric_type(best, question), start, limit, lowest=bool(LOWEST_WORDS.search(question)))
    out = [r.asDict() for r in ranked.collect()]  # ``limit`` at most
    if not out:
        return None
    leaders = list(dict.fromkeys(r["name"] for r in out if r["value"] == out[0]["value"]))
    text = f"{leaders[0]} ranks first with {out[0]['value']}." if len(leaders) == 1 else f"{', '.join(map(str, leaders[:10]))} tie with {out[0]['value']}."
    return Answer(op, text, out, [r["candidate"] for r in out[:12]])


def answer(question: str, entities: DataFrame, edges: DataFrame, vector_search: Callable[[str], list[dict]], generator: Generator) -> Answer:
    """Analytics, then exact names, then vectors; refuses without evidence."""
    if found := analytics(question, entities, edges):
        return found
    contexts = [r.asDict() for r in exact_lookup(entities, name_candidates(question)).limit(4).collect()] if name_candidates(question) else []
    contexts = contexts or vector_search(question)
    if not contexts:
        return Answer("refusal", "There is not enough evidence to answer.")
    text = generator.answer(question, contexts)
    if "INSUFFICIENT_EVIDENCE" in text:
        return Answer("refusal", "There is not enough evidence to answer.")
    return Answer("retrieved", text, contexts, list(dict.fromkeys(str(c.get("id")) for c in contexts)))


def evaluate(cases: Sequence[dict], ask: Callable[[str], Answer]) -> dict[str, float]:
    """Rates over golden questions; a case that raises has failed, no case gives 1."""
    passed = refused = 0
    for case in cases:
        try:
            a = ask(case["question"])
        except Exception:  # noqa: BLE001, S112
            continue
        is_refusal = a.kind == "refusal"
        if not case["should_answer"]:
            refused += is_refusal
            passed += is_refusal
            continue
        said = (a.text + " " + " ".join(str(r) for r in a.rows)).casefold()
        passed += not is_refusal and all(e.casefold() in said for e in case.get("expected_entities") or [])
    unanswerable = sum(not c["should_answer"] for c in cases)
    return {"pass_rate": passed / len(cases) if cases else 1.0, "refusal_rate": refused / unanswerable if unanswerable else 1.0}


# What a generated query may use; names of the parsed plan's nodes and expressions.
FUNCTIONS = {"avg", "coalesce", "collect_list", "collect_set", "count", "max", "min", "size", "sum", "lower", "array_sort", "slice"}
PLAN_NODES = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Join", "SubqueryAlias", "Distinct", "UnresolvedRelation", "UnresolvedHaving", "Offset"}
EXPRESSIONS = {
    "UnresolvedAttribute", "UnresolvedAlias", "UnresolvedStar", "UnresolvedFunction", "Alias", "Literal", "SortOrder", "And", "Or", "Not", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual",
    "In", "IsNull", "IsNotNull", "Like", "Add", "Subtract", "Multiply", "Divide", "UnaryMinus", "CaseWhen", "Cast", "Between", "UnresolvedOrdinal", "UnresolvedExtractValue", "Concat",
}
MAX_LENGTH, MAX_ROWS, MAX_ESTIMATE = 12_000, 500, 100_000


class Refused(ValueError):
    """A generated query that isn't allowed."""


def _strings(value) -> list[str]:
    """``[a, b]`` as the plan writes a sequence of names."""
    return [str(x) for x in value] if isinstance(value, list) else [x.strip() for x in str(value).strip("[]").split(",")]


def _parts(value):
    """Every node and expression of a plan given as JSON, at any depth."""
    if isinstance(value, dict):
        if "class" in value:
            yield value
        for x in value.values():
            yield from _parts(x)
    elif isinstance(value, list):
        for x in value:
            yield from _parts(x)


def guarded_sql(spark: SparkSession, query: str, views: Sequence[str], limit: int = MAX_ROWS, max_estimate: int | None = None) -> DataFrame:
    """Runs a generated SELECT over the named views, after checks of its parsed plan.

    Every node, expression, function and relation of the plan, wherever it stands (a comma, a
    join, a subquery), has to be on its list: so no other table, table function, subquery or
    command passes, however it is written.  Comments and backquotes are refused beforehand, a
    limit is put on the query, and the optimizer's row estimate is bounded where it has one.
    """
    text = query.strip()
    if not text or len(text) > MAX_LENGTH:
        raise Refused("empty or too long")
    if any(x in text for x in (";", "//", "/*", "`", "--")):
        raise Refused("separators, comments and backquotes are not allowed")
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        parts = list(_parts(json.loads(parsed.toJSON())))
    except Exception as e:  # noqa: BLE001
        raise Refused("it can't be parsed") from e
    known, seen = {v.lower() for v in views}, set()
    for part in parts:
        name = part["class"].rsplit(".", 1)[-1].rstrip("$")
        if ".trees." in part["class"] or "num-children" not in part:
            continue
        if name not in PLAN_NODES | EXPRESSIONS:
            raise Refused(f"{name} is not allowed")
        if name == "UnresolvedRelation":
            relation = ".".join(_strings(part["multipartIdentifier"])).lower()
            if relation not in known:
                raise Refused(f"unknown relation {relation}")
            seen.add(relation)
        if name == "UnresolvedFunction" and (f := ".".join(_strings(part["nameParts"])).lower()) not in FUNCTIONS:
            raise Refused(f"function {f} is not allowed")
    if not seen:
        raise Refused("reads no known relation")
    df = spark.sql(text)
    execution = df._jdf.queryExecution()
    if not execution.analyzed().subqueriesAll().isEmpty():
        raise Refused("subqueries are not allowed")
    estimate = execution.optimizedPlan().stats().rowCount()
    if estimate.isDefined() and int(str(estimate.get())) > (max_estimate or MAX_ESTIMATE):
        raise Refused("too many rows expected")
    return df.limit(max(1, min(limit, MAX_ROWS)))

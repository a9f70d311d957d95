"""The graph model: tables, vocabularies and weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weftgraph.runtime import table

# Vocabularies of the graph model.
ENTITY_TYPES = (
    "Person", "Organization", "Technology", "Concept", "System", "Module", "Package", "File", "Class", "Function", "APIEndpoint", "DataModel", "Database", "DataStore", "Queue",
    "ExternalService", "DeploymentUnit", "Environment", "Config", "SecretRef", "Workflow", "UserRole", "Decision", "Requirement", "Issue", "Task", "BusinessEntity",
)
STATUSES = ("candidate", "validated", "rejected", "superseded", "disputed")
PREDICATES = (
    "mentions", "related_to", "relates_to_domain", "blocks", "requires", "decides", "uses", "implements", "supports", "depends_on", "generates", "stores", "classifies",
    "documents", "configures", "runs_on", "exports", "owned_by", "manages", "enriches", "discovers", "creates", "validates", "syncs", "contains", "produces", "reads_from",
    "writes_to", "calls", "imports", "imports_from", "defines", "exposes", "handles", "deploys_to", "evidences", "part_of", "references", "inherits", "rationale_for",
    "shares_data_with", "method", "reports_to", "member_of", "has_role", "has_skill", "located_in", "filed_by", "covered_by", "has_document", "evaluated_by", "triggered_rule",
    "resulted_in", "handled_by", "approved_by", "rejected_by", "paid_to",
)
PREDICATE_ALIASES = {
    "is_required_for": "requires", "required_for": "requires", "needs": "requires", "built_with": "uses", "powered_by": "uses", "uses_for": "uses",
    "create": "generates", "creates": "generates", "produces": "generates", "outputs": "exports", "export": "exports", "backs": "supports", "backed_by": "supports",
    "depends": "depends_on", "configured_by": "configures", "documented_by": "documents", "related": "related_to", "call": "calls", "called_by": "calls",
    "import": "imports", "imported_from": "imports_from", "defined_by": "defines", "expose": "exposes", "served_by": "handles", "deployed_to": "deploys_to", "evidence": "evidences",
}
# Weights of predicates and types.
PREDICATE_WEIGHTS = {
    "exposes": 12, "depends_on": 11, "reads_from": 10, "writes_to": 10, "generates": 10, "predicts": 10, "evaluates": 10, "uses": 8, "calls": 7, "defines": 5,
    "contains": 1, "references": 1,
}
DEFAULT_PREDICATE_WEIGHT = 4
TYPE_WEIGHTS = {
    "APIEndpoint": 10, "Module": 9, "System": 9, "DataModel": 8, "Database": 8, "DataStore": 8, "DeploymentUnit": 7, "BusinessEntity": 7, "Technology": 6,
    "ExternalService": 6, "Class": 4, "Function": 3, "File": 1, "Concept": 1,
}
# Kinds of predicates and types, names and folders that count for nothing, sections of a page.
FLOW_PREDICATES = ("calls", "depends_on", "imports", "imports_from", "inherits", "shares_data_with", "uses")
HOTSPOT_TYPES = ("System", "Package", "Module", "Class", "DataModel", "APIEndpoint", "Workflow", "DataStore", "ExternalService")
LINEAGE_TYPES = ("DataModel", "Database", "DataStore", "System", "Technology")
GENERIC_NAMES = (
    "any", "dataframe", "dict", "index", "list", "none", "object", "optional", "path", "protocol", "series", "str", "string", "valueerror",
)
HIDDEN_PATH_PARTS = (".venv", "__pycache__", "build", "dist", "generated", "logs", "node_modules", "site-packages", "tests")
ARCHITECTURE_MARKERS = ("packages", "services", "apps", "src")
SECTIONS = (
    ("Architecture", ("depends_on", "uses", "runs_on", "deploys_to", "part_of", "supports"), ("Module", "System", "DeploymentUnit", "Technology", "ExternalService")),
    ("API", ("exposes", "handles", "calls", "requires"), ("APIEndpoint", "Function", "Module", "System")),
    ("Structured Data", ("reads_from", "writes_to", "stores", "generates"), ("DataModel", "Database", "DataStore", "BusinessEntity")),
    ("Supporting Code", ("defines", "calls", "imports", "imports_from", "inherits", "references", "contains"), ("File", "Class", "Function", "Concept")),
)


@dataclass(frozen=True)
class Graph:
    """One graph as DataFrames; ``project_slug`` is a column of each."""

    sources: DataFrame
    spans: DataFrame
    chunks: DataFrame
    entities: DataFrame
    assertions: DataFrame


def load_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The delivered tables, each id once: the first row wins."""
    from weftgraph.operators.merge import first_wins

    one = lambda name, order: first_wins(table(spark, sf_dir, name), ("project_slug", "id"), order)
    return Graph(
        one("sources", ("ingested_at",)), one("source_spans", ("ingested_at",)), one("chunks", ("ingested_at",)),
        one("entities", ("ord", "ingested_at")), one("assertions", ("ord", "created_at")),
    )

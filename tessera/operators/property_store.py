"""Loading the reified graph of export.property_graph() into a property-graph database, partition by partition.

A session is anything with run(statement, rows) and close(); connect() makes one in each task. All statements
merge by identity, so loading twice changes nothing, and nothing is deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row

from tessera.operators.export import property_graph, repeated_keys

LABELS = ("Entity", "Document", "Assertion", "Evidence")
#: Kind of edge -> labels of its ends.
KINDS = {"ASSERTS": ("Entity", "Entity"), "SUBJECT": ("Assertion", "Entity"), "OBJECT": ("Assertion", "Entity"), "SUPPORTS": ("Evidence", "Assertion"), "FROM_DOCUMENT": ("Evidence", "Document")}
BATCH = 1000


def constraints() -> list[str]:
    """One uniqueness constraint for each label."""
    return [f"CREATE CONSTRAINT {label.lower()}_id IF NOT EXISTS FOR (n:{label}) REQUIRE n.id IS UNIQUE" for label in LABELS]


def node_statement(label: str) -> str:
    """Merge nodes of a label from rows of id and props; an assertion keeps its greatest confidence."""
    sure = "CASE WHEN old IS NULL OR row.props.confidence > old THEN row.props.confidence ELSE old END"
    kept = f" WITH n, row, n.confidence AS old SET n += row.props SET n.confidence = {sure}" if label == "Assertion" else " SET n += row.props"
    return f"UNWIND $rows AS row MERGE (n:{label} {{id: row.id}}){kept}"


def edge_statement(kind: str) -> str:
    """Merge edges of a kind from rows of src, dst and via, the identity of a direct assertion."""
    a, b = KINDS[kind]
    own = " {id: row.via}" if kind == "ASSERTS" else ""
    return f"UNWIND $rows AS row MATCH (a:{a} {{id: row.src}}) MATCH (b:{b} {{id: row.dst}}) MERGE (a)-[:{kind}{own}]->(b)"


def _in_batches(rows: Iterator[Row], key: str, make: Callable[[Row], dict[str, Any]]) -> Iterator[tuple[str, list[dict[str, Any]]]]:
    """(label or kind, rows) of BATCH rows at most."""
    waiting: dict[str, list[dict[str, Any]]] = {}
    for r in rows:
        part = waiting.setdefault(r[key], [])
        part.append(make(r))
        if len(part) == BATCH:
            yield r[key], waiting.pop(r[key])
    yield from waiting.items()


def load(entities: DataFrame, relations: DataFrame, connect: Callable[[], Any]) -> tuple[int, int]:
    """Load all nodes, then all edges; returns (entities, relations). Repeated identities of entities are refused."""
    if not repeated_keys(entities, "canonical_id").isEmpty():
        raise ValueError("one entity has two rows")
    session = connect()
    try:
        for statement in constraints():
            session.run(statement, [])
    finally:
        session.close()

    def send(rows: Iterator[Row], key: str, make: Callable[[Row], dict[str, Any]], statement: Callable[[str], str]) -> None:
        own = connect()
        try:
            for name, part in _in_batches(rows, key, make):
                own.run(statement(name), part)
        finally:
            own.close()

    nodes, edges = property_graph(entities, relations)
    nodes.foreachPartition(lambda rows: send(rows, "label", lambda r: {"id": r["node_id"], "props": json.loads(r["props"])}, node_statement))
    edges.foreachPartition(lambda rows: send(rows, "kind", lambda r: {"src": r["src"], "dst": r["dst"], "via": r["via"]}, edge_statement))
    return entities.count(), relations.count()


def connector(settings: dict[str, Any]) -> Callable[[], Any]:
    """connect() for a database that speaks Bolt, over the public neo4j driver, which has to be installed."""

    class Session:
        def __init__(self):
            import neo4j

            self.driver = neo4j.GraphDatabase.driver(settings["uri"], auth=(settings.get("user", "neo4j"), settings["password"]))

        def run(self, statement: str, rows: list[dict[str, Any]]) -> None:
            self.driver.execute_query(statement, rows=rows, database_=settings.get("database", "neo4j"))

        def close(self) -> None:
            self.driver.close()

    return Session

"""A finished session as lazy DataFrames with the graph queries as methods, and the stages that build one."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import export as X
from graphloom.operators import graph as G
from graphloom.sources.files import read_session


class Session:
    """nodes, edges, concepts and properties of a session folder, or of given tables. Every method returns DataFrames; stats, context and path_between run jobs to make them."""

    def __init__(self, spark: SparkSession, path: str | None = None, tables: dict[str, DataFrame] | None = None):
        self.spark, self.path = spark, path
        self.reload(tables)

    def reload(self, tables: dict[str, DataFrame] | None = None) -> None:
        """Reads the folder again, or takes other tables."""
        t = tables or read_session(self.spark, self.path)
        self.nodes, self.concepts, self.properties = t["nodes"], t.get("concepts"), t.get("properties")
        name = F.try_element_at("attributes", F.lit("name")).getField("value")
        self.entities = self.nodes.select("id", "type", name.alias("name"), "confidence")
        self.mentions, self.chunks, self.raw_edges = t.get("mentions"), t.get("chunks"), t["edges"]
        self.edges = t["edges"].select("id", "type", F.col("from").alias("src"), F.col("to").alias("dst"), "confidence", "method")
        own = self.nodes.select("id", "type", name.alias("name"))
        self.names = own.unionByName(self.nodes.select("id", "type", F.explode("aliases").alias("name"))).where("name is not null")
        self.attributes = self.nodes.select("id", "type", F.explode("attributes").alias("attr", "a")).select("id", "type", "attr", "a.value", "a.confidence")

    def search(self, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        return G.search(self.names, self.attributes, query, kind, limit)

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def neighbors(self, node_id: str, direction: str = "both", kind: str | None = None, limit: int = 50) -> DataFrame:
        return G.neighbours(self.edges, node_id, direction, kind, limit)

    def path_between(self, a: str, b: str, most: int = 5) -> DataFrame:
        return G.shortest_path(self.edges, a, b, most)

    def path_edges(self, a: str, b: str, most: int = 5) -> DataFrame:
        return G.path_edges(self.path_between(a, b, most), self.edges)

    def neighbor_summaries(self, node_id: str, direction: str = "both", kind: str | None = None, limit: int = 50) -> DataFrame:
        return G.neighbour_summaries(self.neighbors(node_id, direction, kind, limit), self.entities)

    def subgraph(self, ids: list[str] | None = None, types: list[str] | None = None, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
        return G.subgraph(self.entities, self.edges, ids, types, least)

    def stats(self) -> DataFrame:
        return G.statistics(self.entities, self.edges, self.nodes.select(F.explode("source_files").alias("source_file")))

    def context(self, question: str, depth: int = 2) -> DataFrame:
        return G.within(self.edges, G.context_seeds(self.names, self.attributes, question).select("id"), depth)

    def context_text(self, question: str, mode: str = "bfs", depth: int = 2, budget: int = 2000) -> DataFrame:
        seeds = [r["id"] for r in G.context_seeds(self.names, self.attributes, question).collect()]  # three at most
        return G.context_text(self.entities, self.attributes, self.edges, seeds, question, mode, depth, budget)

    def source(self, node: str | None = None, edge: str | None = None, most: int = 3) -> DataFrame:
        """Excerpts of the chunks that a node, or both ends of an edge, stand in: needs the tables mentions and chunks."""
        if (node is None) == (edge is None):
            raise ValueError("either a node or an edge must be named")
        if self.mentions is None or self.chunks is None:
            raise ValueError("this session has no tables of mentions and chunks")
        ends = None
        if edge is not None:
            r = self.edges.where(F.col("id") == edge).select("src", "dst").first()
            if r is None:
                raise ValueError(f"no edge {edge}")
            ends = (r["src"], r["dst"])
        return G.source_excerpts(self.mentions, self.chunks, self.names, node, ends, most)

    def export(self, folder: str) -> dict[str, list[str]]:
        """Writes nodes and edges as JSON lines, Turtle, and a CSV bundle below a folder; returns the columns of the bundle."""
        X.write_json(self.nodes, f"{folder}/nodes.jsonl")
        X.write_text(self.turtle(), f"{folder}/graph.ttl")
        up = self.concepts.select("type", F.lit("").alias("session_id"), "parent") if self.concepts is not None else self.spark.createDataFrame([], "type string, session_id string, parent string")
        from graphloom.operators.ontology import parents

        nodes = X.node_properties(self.nodes, self.attributes.select("id", "attr", "value", "confidence"), parents(up))
        edges = X.edge_properties(self.raw_edges.withColumnsRenamed({"from": "src", "to": "dst"}), self.raw_edges.select("id", F.explode("attributes").alias("attr", "a")).select("id", "attr", "a.value", "a.confidence"))
        return X.write_csv_bundle(nodes, edges, f"{folder}/csv")

    def merge(self, other: Session, names: tuple[str, str] = ("session_a", "session_b")) -> Session:
        """A session of both graphs: nodes and edges of either, their files under the session's name; of equal ids the one of higher confidence."""
        from graphloom.operators.merge import namespaced
        from graphloom.operators.orphans import appended

        parts = [[namespaced(t, n, (), ("source_files",)) for t in (s.nodes, s.raw_edges)] for s, n in zip((self, other), names)]
        nodes, edges = (appended(a, b.select(a.columns), ["id"], "confidence") for a, b in zip(*parts))
        schema = {k: a.unionByName(b).dropDuplicates([key]) for k, key, a, b in (("concepts", "type", self.concepts, other.concepts), ("properties", "name", self.properties, other.properties)) if a is not None and b is not None}
        return Session(self.spark, tables={"nodes": nodes, "edges": edges, **schema})

    def hubs(self, top: int = 10) -> DataFrame:
        return G.hubs(self.edges, top)

    def orphans(self) -> DataFrame:
        return G.orphans(self.entities, self.edges)

    def types(self) -> DataFrame:
        return G.type_counts(self.entities).orderBy(F.desc("n"), "type")

    def schema(self) -> DataFrame:
        return self.concepts

    def note(self, node_id: str) -> DataFrame:
        near = self.edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))
        return X.note(X.note_lines(self.entities, self.attributes, near), node_id)

    def turtle(self) -> DataFrame:
        alias = self.nodes.select("id", F.explode("aliases").alias("alias"))
        return X.turtle_prefixes(self.spark).unionByName(X.schema_turtle(self.concepts, self.properties)).unionByName(X.graph_turtle(self.entities, self.attributes, alias, X.declared_relations(self.edges, self.properties)))


def list_sessions(spark: SparkSession, root: str) -> DataFrame:
    """session, nodes: the sessions below a folder with the lines of their nodes, newest name first. The folder's name guards against paths that lead out of it."""
    if ".." in root.split("/"):
        raise ValueError("the path leads out of its folder")
    lines = spark.read.format("text").load(f"{root}/*/output/nodes.jsonl").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/output/nodes\.jsonl$", 1).alias("session"), "value")
    return lines.where("value <> ''").groupBy("session").agg(F.count("*").alias("nodes")).orderBy(F.desc("session"))


@dataclass
class Stage:
    """A step of a build: a function of the tables made so far, and the tables it makes."""

    name: str
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    outputs: tuple[str, ...]
    blocking: bool = True
    review: bool = False
    feedback: Callable[[dict[str, DataFrame], Exception], dict[str, DataFrame]] | None = None


@dataclass
class Build:
    """Runs stages in order, each table written once under `root`; a stage all of whose tables are there is skipped.

    The state (pending, running, waiting, done, failed) is written after every change. A failed stage is tried twice, and a
    third time by its feedback, which is told what went wrong; wrong use (ValueError, KeyError) is not tried again. One that
    doesn't block only leaves a warning. A stage under review waits until approve() was called.
    """

    spark: SparkSession
    root: str
    stages: list[Stage]
    state: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _there(self, table: str) -> bool:
        fs, p = self._fs(f"{self.root}/{table}/_SUCCESS")
        return fs.exists(p)

    def _set(self, stage: str, state: str) -> None:
        """Writes the state beside the tables: to a new file that then takes the old one's place at once."""
        self.state[stage] = state
        fs, new = self._fs(f"{self.root}/state.json.new")
        _, old = self._fs(f"{self.root}/state.json")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        replace = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        replace[0] = hadoop.Options.Rename.OVERWRITE
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(old), replace)

    def approve(self, stage: str) -> None:
        self._set(stage, "approved")

    def invalidate(self, stage: str, keep: tuple[str, ...] = ()) -> None:
        """Drops the tables of a stage and all later ones, but for those to keep."""
        names = [s.name for s in self.stages]
        for s in self.stages[names.index(stage) :]:
            self._set(s.name, "pending")
            for t in s.outputs:
                if t not in keep:
                    fs, p = self._fs(f"{self.root}/{t}")
                    fs.delete(p, True)

    def _attempts(self, s: Stage, tables: dict[str, DataFrame]) -> None:
        for attempt in range(3 if s.feedback else 2):
            try:
                made = s.run(tables) if attempt < 2 else s.feedback(tables, failure)
                for name, df in made.items():
                    df.write.mode("overwrite").parquet(f"{self.root}/{name}")
                self._set(s.name, "done")
                return
            except Exception as e:
                failure = e
                if attempt == (2 if s.feedback else 1) or isinstance(e, (ValueError, KeyError)):
                    self._set(s.name, "failed")
                    if s.blocking:
                        raise
                    self.warnings.append(f"{s.name}: {e}")
                    return

    def run(self, until: str | None = None, only: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
        """The tables of all stages, up to `until`; with `only`, other stages are not run, but their tables are read if they are there."""
        tables: dict[str, DataFrame] = {}
        for s in self.stages:
            if (only is None or s.name in only) and not all(map(self._there, s.outputs)):
                if s.review and self.state.get(s.name) != "approved":
                    self._set(s.name, "waiting")
                    return tables
                self._set(s.name, "running")
                self._attempts(s, tables)
            for t in s.outputs:
                if self._there(t):
                    tables[t] = self.spark.read.parquet(f"{self.root}/{t}")
            if s.name == until:
                break
        return tables


@dataclass(frozen=True)
class Config:
    """Settings of a run. A profile replaces whole sections; nothing is merged below that."""

    sections: dict
    active: str | None = None

    @staticmethod
    def read(text: str) -> Config:
        import yaml

        return Config(yaml.safe_load(text) or {})

    def profile(self, name: str) -> Config:
        p = self.sections.get("profiles", {})
        if name not in p:
            raise KeyError(f"no profile {name}")
        return Config({**self.sections, **p[name]}, name)

    def get(self, *path: str, default=None):
        at = self.sections
        for k in path:
            if not isinstance(at, dict) or k not in at:
                return default
            at = at[k]
        return at

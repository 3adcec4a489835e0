"""Log-shaped views over the driver's tables.

Every view keeps all rows of the tables it is built from.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemograph import schema as V
from mnemograph.functions import columns as C
from mnemograph.operators.skew import next_row

NTZ = "timestamp_ntz"
EPOCH = "2024-01-01 00:00:00"
AS_OF = "2024-02-01 00:00:00"
NODE_TYPES = [
    "person", "place", "project", "goal", "preference", "event", "asset", "tool", "generic", "log",
]


def ntz(text: str):
    return F.lit(text).cast(NTZ)


def shifted(unit: str, amount: str, base: str = EPOCH):
    return F.expr(f"timestampadd({unit}, cast({amount} as int), timestamp_ntz'{base}')")


_SCHEMAS: dict[tuple[str, str], object] = {}


class Views:
    """Lazy views for one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """One driver table; its schema is read from the footer once per process."""
        key, path = (self.folder, name), f"{self.folder}/{name}.parquet"
        if key not in _SCHEMAS:
            _SCHEMAS[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[key]).parquet(path)

    @cached_property
    def n_vectors(self) -> int:
        return self.table("embeddings").count()

    @cached_property
    def entries(self) -> DataFrame:
        return self.table("documents").select(
            F.concat(F.lit("log-"), "doc_id").alias("id"),
            F.lit("log").alias("node_type"),
            F.col("text").alias("content"),
            "source",
            shifted("MINUTE", "doc_id * 37").alias("ts"),
            F.lit(V.WEIGHTS["log"]).alias("weight"),
            F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("img-"), "doc_id")).otherwise("").alias("image_url"),
        )

    @cached_property
    def event_logs(self) -> DataFrame:
        return self.table("events").select(
            F.concat(F.lit("ev-"), "event_id").alias("id"),
            F.col("event_type").alias("source"),
            "ts",
            F.col("user_id").alias("owner"),
            F.col("value").alias("score"),
            F.col("props").alias("metadata"),
        )

    @cached_property
    def turns(self) -> DataFrame:
        return next_row(self.table("conversations"), ["conv_id"], "turn", ["role", "text"], "following")

    @cached_property
    def queries(self) -> DataFrame:
        answered = F.col("following.role") == "assistant"
        return self.turns.filter(F.col("role") == "user").select(
            F.concat_ws("-", F.lit("qry"), "conv_id", "turn").alias("id"),
            "conv_id",
            "turn",
            F.col("text").alias("question"),
            F.when(answered, F.col("following.text")).otherwise("").alias("answer"),
            F.lit("chat").alias("source"),
            (~F.coalesce(answered, F.lit(False))).alias("is_gap"),
            shifted("MINUTE", "conv_id * 60 + turn").alias("ts"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        q = self.queries
        resolved = ~F.col("is_gap")
        return q.select(
            F.regexp_replace("id", "^qry", "pq").alias("id"),
            "question",
            F.element_at(F.array(*map(F.lit, ["gap", "contradiction", "task_proposal"])), (F.col("turn") % 3 + 1).cast("int")).alias("kind"),
            F.concat(F.lit("conversation "), "conv_id").alias("context"),
            (F.col("conv_id") % 6).alias("ask_count"),
            F.when(F.col("conv_id") % 6 > 0, shifted("DAY", "turn")).alias("last_asked"),
            F.col("ts").alias("created"),
            F.when(resolved, F.col("ts") + F.expr("INTERVAL '1' HOUR")).alias("resolved"),
            F.col("answer"),
            F.concat(F.lit("client-"), F.col("conv_id") % 50).alias("client"),
            (F.col("conv_id") % self.n_vectors).alias("vec_id"),
        )

    @cached_property
    def nodes(self) -> DataFrame:
        docs = self.table("documents").select(F.col("doc_id").alias("vec_id"), "text")
        vec = F.col("vec_id")
        pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (by + 1).cast("int"))
        status = F.concat(F.lit('{"status": "'), pick(V.PROJECT_STATUSES, vec % 7), F.lit('"}'))
        other = F.concat(
            F.lit('{"category": "'), pick(["food", "Tech", "garden", "home"], vec % 4),
            F.lit('", "type": "'), pick(["work", "Software", "party"], vec % 3),
            F.lit('", "extra": '), vec.cast("string"), F.lit("}"),
        )
        return (
            self.table("embeddings")
            .join(docs, "vec_id", "left")
            .select(
                F.concat(F.lit("node-"), "vec_id").alias("id"),
                "vec_id",
                pick(NODE_TYPES, F.col("label")).alias("node_type"),
                F.coalesce("text", F.lit("")).alias("content"),
                F.when(F.col("label").isin(2, 3), status).otherwise(other).alias("metadata"),
                F.round(0.1 * (1 + vec % 9), 1).alias("weight"),
                shifted("DAY", "-vec_id").alias("ts"),
                "embedding",
            )
        )

    @cached_property
    def search_inputs(self) -> DataFrame:
        """One search per node: its vector and the first two words of its text."""
        first_two = F.slice(F.filter(F.split("content", r"\s+"), lambda w: w != ""), 1, 2)
        return self.nodes.select(
            F.concat(F.lit("q-"), "vec_id").alias("qid"),
            "vec_id",
            F.array_join(first_two, " ").alias("query"),
            "embedding",
            F.col("ts").alias("query_ts"),
        )

    @cached_property
    def near(self) -> DataFrame:
        """Candidates close to a node: its vector plus a share of the following one."""
        n = self.n_vectors
        e = self.table("embeddings")
        after = e.select(((F.col("vec_id") + (n - 1)) % n).alias("vec_id"), F.col("embedding").alias("_next"))
        pick = F.element_at(F.array(*map(F.lit, NODE_TYPES)), (F.col("label") + 1).cast("int"))
        share = 0.1 * (1 + F.col("vec_id") % 10)
        return e.join(after, "vec_id").select(
            F.concat(F.lit("cand-"), "vec_id").alias("qid"),
            "vec_id",
            pick.alias("node_type"),
            F.zip_with(
                "embedding", "_next", lambda a, b: a.cast("double") + share * b.cast("double")
            ).alias("embedding"),
        )

    def _people(self) -> list[DataFrame]:
        node = lambda df, key, prefix, name, kind: df.select(
            F.concat(F.lit(prefix), key).alias("id"),
            F.col(name).cast("string").alias("content"),
            F.lit(kind).alias("node_type"),
            F.lit(V.WEIGHTS["entity"]).alias("weight"),
            (F.col(key) % self.n_vectors).alias("vec_id"),
        )
        return [
            node(self.table("customer"), "c_custkey", "cust-", "c_name", "person"),
            node(self.table("supplier"), "s_suppkey", "supp-", "s_name", "person"),
            node(self.table("nation"), "n_nationkey", "nat-", "n_name", "place"),
            node(self.table("region"), "r_regionkey", "reg-", "r_name", "place"),
            node(self.table("orders"), "o_orderkey", "ord-", "o_orderpriority", "asset"),
        ]

    @cached_property
    def relationships(self) -> DataFrame:
        def rel(df, subject, predicate, obj, ts):
            return df.select(
                subject.alias("subject_id"), F.lit(predicate).alias("predicate"), obj.alias("object_id"), ts.alias("ts")
            )

        key = lambda prefix, c: F.concat(F.lit(prefix), c)
        start = ntz(EPOCH)
        c, s, n, o = (self.table(t) for t in ("customer", "supplier", "nation", "orders"))
        rows = (
            rel(c, key("cust-", "c_custkey"), "lives_in", key("nat-", "c_nationkey"), start)
            .unionByName(rel(s, key("supp-", "s_suppkey"), "located_in", key("nat-", "s_nationkey"), start))
            .unionByName(rel(n, key("nat-", "n_nationkey"), "located_in", key("reg-", "n_regionkey"), start))
            .unionByName(rel(o, key("cust-", "o_custkey"), "owns", key("ord-", "o_orderkey"), F.col("o_orderdate")))
        )
        return rows.select(
            C.relationship_id(F.col("subject_id"), F.col("predicate"), F.col("object_id")).alias("id"),
            F.lit("relationship").alias("node_type"),
            F.concat_ws(" ", "subject_id", "predicate", "object_id").alias("content"),
            "subject_id",
            "predicate",
            "object_id",
            F.array("subject_id", "object_id").alias("entity_links"),
            "ts",
            F.lit(V.WEIGHTS["relationship"]).alias("weight"),
        )

    @cached_property
    def graph_nodes(self) -> DataFrame:
        """Entities and reified relationships in one table; entities have vectors."""
        people = self._people()
        entities = people[0]
        for part in people[1:]:
            entities = entities.unionByName(part)
        vectors = self.table("embeddings").select("vec_id", "embedding")
        entities = entities.join(vectors, "vec_id", "left").drop("vec_id")
        return entities.unionByName(self.relationships, allowMissingColumns=True)

    @cached_property
    def observations(self) -> DataFrame:
        """One lives_in observation per order of a customer."""
        c = self.table("customer").select("c_custkey", "c_nationkey")
        o = self.table("orders")
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.concat(F.lit("cust-"), "c_custkey").alias("subject_id"),
            F.lit("lives in").alias("predicate"),
            F.concat(F.lit("nat-"), "c_nationkey").alias("object_id"),
            F.concat(F.lit("ord-"), "o_orderkey").alias("entry_id"),
            F.col("o_orderdate").alias("ts"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        o = F.col("o_orderkey")
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.concat(F.lit("task-"), o).alias("id"),
            F.when(o % 5 == 0, "").otherwise(F.concat(F.lit("task-"), o - o % 5)).alias("parent_id"),
            F.when(status == "F", "completed").when(status == "O", "active").otherwise("pending").alias("status"),
            F.col("o_orderpriority").alias("content"),
            F.concat(F.lit("entry-"), "o_custkey").alias("entry_id"),
            F.col("o_orderdate").alias("ts"),
            (o % self.n_vectors).alias("vec_id"),
        )

    @cached_property
    def analysed(self) -> DataFrame:
        """One entry per order; its ``entry_analysis`` names the customer and the priority as entities."""
        o = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        raw = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "ongoing").otherwise("")
        entity = lambda name, kind, status: F.struct(
            F.col(name).alias("name"), kind.alias("type"), status.alias("status")
        )
        entities = F.array(
            entity("c_name", F.col("c_mktsegment"), raw), entity("o_orderpriority", F.lit("priority"), F.lit("Scheduled"))
        )
        analysis = F.struct(
            F.concat(F.lit("order for "), "c_mktsegment").alias("summary"),
            F.lit("calm").alias("mood"),
            F.col("o_orderpriority").alias("category"),
            F.array("c_mktsegment", "o_orderstatus").alias("tags"),
            entities.alias("entities"),
        )
        return o.select(
            F.concat(F.lit("ord-"), "o_orderkey").alias("id"),
            F.concat(F.lit("order placed, priority "), "o_orderpriority").alias("content"),
            F.lit("shop").alias("source"),
            F.col("o_orderdate").alias("ts"),
            F.when(F.col("o_orderkey") % 9 > 0, F.to_json(analysis)).otherwise("{broken").alias("entry_analysis"),
        )

    @cached_property
    def model_text(self) -> DataFrame:
        """Model output per document: a summary, one to three triple lines, a few questions."""
        w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
        word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit("x"))
        d = F.col("doc_id")
        line = lambda parts: F.concat_ws(" | ", *parts)
        lines = F.array(
            line([word(0), F.lit("works at"), word(1), F.lit("Person"), F.lit("City")]),
            F.when(d % 2 == 0, line([F.when(d % 4 == 0, "I").otherwise(word(2)), F.lit("based-in"), word(3)])),
            F.when(d % 3 == 0, line([word(4), F.lit("NEW:mentors")] + ([F.lit("a"), F.lit("b")]))),
        )
        return self.table("documents").select(
            F.concat(F.lit("log-"), d).alias("id"),
            F.when(d % 5 > 0, F.concat(F.lit("Owner "), d % 5)).otherwise("").alias("owner"),
            shifted("MINUTE", "doc_id * 37").alias("ts"),
            F.concat(
                F.lit("Here is the result:\nSummary: "), F.array_join(F.slice(w, 1, 5), " "),
                F.lit("\nsignificance: "), ((d % 13) / 10.0).cast("string"),
                F.lit("\nfuture_commitment: "), ((d % 11) / 10.0).cast("string"),
                F.lit("\ncommitment_intent: "), F.array_join(F.slice(w, 1, 3), " "),
                F.lit("\ntriples:\n"), F.array_join(lines, "\n"),
                F.lit("\nsubtasks:\n"), word(0), F.lit(" | do "), word(1), F.lit(" | "), word(2), F.lit(", "), word(3),
                F.lit("\nno separator here\nquestions:\nWhat is "), word(0), F.lit("? | reason: "), word(1),
                F.lit("\nWhy "), word(2), F.lit("?\n"),
            ).alias("text"),
        )

    @cached_property
    def calls(self) -> DataFrame:
        models = [
            "gemini-2.5-flash", "models/gemini-1.5-pro", "gemini-1.5-flash-8b", "gemini-2.5-flash-lite-preview",
            "unlisted-model",
        ]
        e = F.col("event_id")
        return self.table("events").select(
            F.concat(F.lit("call-"), e).alias("id"),
            F.element_at(F.array(*map(F.lit, models)), (e % 5 + 1).cast("int")).alias("model"),
            F.when(e % 7 > 0, F.round(F.col("value") * 100).cast("bigint")).alias("prompt_tokens"),
            F.when(e % 7 > 0, e % 500).alias("completion_tokens"),
            (F.octet_length("props") * 100).alias("input_bytes"),
            F.col("user_id").alias("trace_id"),
            F.col("event_type").alias("path"),
            F.col("value").alias("seconds"),
            "ts",
        )

    @cached_property
    def tool_calls(self) -> DataFrame:
        """Tool calls of runs: one run per user and hour, arguments as JSON."""
        return self.table("events").select(
            F.concat_ws("-", F.lit("run"), "user_id", F.date_format("ts", "yyyyMMdd")).alias("run_id"),
            F.col("event_id").alias("iteration"),
            F.col("event_type").alias("tool"),
            F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"query": " Topic '), F.col("event_id") % 3, F.lit(' "}')))
            .otherwise(F.col("props"))
            .alias("arguments"),
            (F.col("event_type") != "error").alias("success"),
            "ts",
        )

"""Incremental jobs on Structured Streaming.

Every job has a root folder. It reads files as they arrive, is triggered with
``availableNow`` and keeps offsets, tables and pending rows under its root, so a new process
on the same root goes on where the last one stopped. Late and back-dated rows are seen once,
when they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemograph import schema as V
from mnemograph.functions import columns as C, outputs
from mnemograph.operators import merge
from mnemograph.operators.dedup import replay_tasks
from mnemograph.plans.reports import should_skip
from mnemograph.operators.skew import top_rows
from mnemograph.operators.vector import signatures
from mnemograph.session import stage, versions
from mnemograph.sources.versioned import Versioned, bucket, touched

HOT_EDGES = "object_id string, slot int, id string, score double"


def read_files(spark: SparkSession, folder: str, like: DataFrame, pattern: str | None = None, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(like.schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def run_batches(stream: DataFrame, root: str, handle) -> None:
    """Drain a stream through ``handle(batch, batch_id)``; its offsets live in ``root``.

    The same root resumes where the last run ended: a batch that was being handled comes
    again under its number, files that arrived meanwhile follow.
    """
    state = f"{root}/checkpoint"
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


class Batches:
    """A table kept as one complete folder per batch; what there is, is read from the folders."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def numbers(self, before: int | None = None) -> list[int]:
        return [n for n in versions(self.spark, self.path) if before is None or n < before]

    def write(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/version={number}")

    def read(self, before: int | None = None, numbers: list[int] | None = None) -> DataFrame:
        """All rows, with their ``version``."""
        kept = self.numbers(before) if numbers is None else numbers
        if not kept:
            return self.spark.createDataFrame([], f"{self.schema}, version int")
        paths = [f"{self.path}/version={n}" for n in kept]
        return self.spark.read.schema(f"{self.schema}, version int").option("basePath", self.path).parquet(*paths)


class TaskDedupJob:
    """First task per entry and normalised content inside the window, whatever order rows arrive in.

    Rows hold (id, entry_id, content, ts). A batch is replayed in time order together with
    the stored tasks of its keys; what it creates is stored. A row that is older than all
    stored ones is created, so late files lose nothing. Stored tasks lie in buckets of
    their key: a batch reads and writes those it hits.
    """

    SCHEMA = "id string, entry_id string, content string, ts timestamp_ntz, bucket int"

    def __init__(self, spark: SparkSession, root: str, seconds: int = 30, buckets: int = 16):
        self.spark, self.root, self.seconds, self.buckets = spark, root, seconds, buckets
        self.created = Versioned(spark, f"{root}/created", self.SCHEMA, "bucket")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        key = ["entry_id", C.dedup_text(F.col("content")).alias("norm")]
        rows = batch.select("id", "entry_id", "content", "ts").dropDuplicates(["id"])
        rows = stage(rows.withColumn("bucket", bucket(F.struct("entry_id", key[1]), self.buckets)), "tasks")
        hit = touched(rows)
        held = self.created.read(before=batch_id, only=hit)
        rows = stage(rows.join(held.select("id"), "id", "left_anti"), "tasks")
        stored = held.withColumn("norm", key[1]).join(rows.select(*key).distinct(), ["entry_id", "norm"], "left_semi").drop("norm")
        both = rows.withColumn("stored", F.lit(False)).unionByName(stored.withColumn("stored", F.lit(True)))
        made = replay_tasks(both, self.seconds).filter("id = created_id").select("id")
        self.created.publish(held.unionByName(rows.join(made, "id", "left_semi")), batch_id, hit)

    def table(self) -> DataFrame:
        return self.created.read().drop("bucket")


def late_rows(stream: DataFrame, root: str) -> DataFrame:
    """All rows with a flag ``late``: older than the newest row of an earlier batch."""
    spark = stream.sparkSession
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    rows = Batches(spark, f"{root}/rows", f"{columns}, late boolean")
    newest = Batches(spark, f"{root}/newest", "newest timestamp_ntz")

    def handle(batch: DataFrame, batch_id: int) -> None:
        last = newest.read(numbers=newest.numbers(before=batch_id)[-1:]).select("newest")
        before = last.agg(F.max("newest")).first()[0]
        flag = F.lit(False) if before is None else F.coalesce(F.col("ts") < F.lit(before).cast("timestamp_ntz"), F.lit(False))
        rows.write(batch.withColumn("late", flag), batch_id)
        newest.write(batch.select(F.col("ts").alias("newest")).unionByName(last).agg(F.max("newest").alias("newest")), batch_id)

    run_batches(stream, root, handle)
    return rows.read().drop("version")


class CycleJob:
    """Entries since the last cycle, processed when there are enough of them or enough time has passed.

    Rows that do not reach the threshold wait in a pending table and join the next batch.
    ``most`` caps a cycle at its oldest rows; the rest stays pending. ``tick`` gives the
    hours since the last cycle; ``close`` processes what still waits. A batch that comes
    again starts from the pending rows before it.
    """

    ROWS = "id string, ts timestamp_ntz"

    def __init__(self, spark: SparkSession, root: str, least: int = 5, hours: float = 24, most: int | None = None):
        self.spark, self.root = spark, root
        self.least, self.hours, self.most = least, hours, most
        self.waiting = Batches(spark, f"{root}/pending", self.ROWS)
        self.done = Batches(spark, f"{root}/cycles", self.ROWS)
        self.closed = Batches(spark, f"{root}/closed", self.ROWS)

    def pending(self, before: int | None = None) -> DataFrame:
        last = self.waiting.numbers(before)[-1:]
        return self.waiting.read(numbers=[] if last == self.closed.numbers(before)[-1:] else last).drop("version")

    def handle(self, batch: DataFrame, batch_id: int, tick: float | None = None, forced: bool = False) -> None:
        waiting = batch.select("id", "ts").unionByName(self.pending(before=batch_id))
        since = tick if self.done.numbers(before=batch_id) else None
        if should_skip(waiting.count(), since, forced, self.least, self.hours):
            self.done.write(waiting.limit(0), batch_id)
            self.waiting.write(waiting, batch_id)
        else:
            self.done.write(waiting if self.most is None else waiting.orderBy("ts", "id").limit(self.most), batch_id)
            taken = self.done.read(numbers=[batch_id])
            self.waiting.write(waiting.join(taken.select("id"), "id", "left_anti"), batch_id)

    def close(self) -> None:
        """Process all pending rows, as a cycle of the last batch: one write, which makes them done and no longer pending."""
        last = self.waiting.numbers()[-1:]
        if last and last != self.closed.numbers()[-1:]:
            self.closed.write(self.pending(), last[0])

    def processed(self) -> DataFrame:
        return self.done.read().unionByName(self.closed.read()).withColumnRenamed("version", "cycle")


class IngestJob:
    """Model output of new entries into graph tables, as one set of changes per batch.

    Batch: triples -> node ids -> relationships and evidence -> links from both ends and
    the entry, hot edges of the objects -> proposals. ``embed`` turns (id, text) into (id, embedding);
    with it a name takes the node of its type that is nearest within 0.15, stored or of the
    same batch, and new nodes keep their vectors. Without it only ids and names are compared.

    Every table is hashed into ``buckets``. A batch reads the buckets its keys fall into, and publishes
    just those as its version, so its work doesn't grow with the number of batches. Vectors are found by
    signs against random planes, one bucket for each of ``tables`` signatures of ``bits`` bits, and probed with one bit
    turned as well: at the threshold a node is missed with a probability of (1 - P)^tables, P that of at most one
    different sign (0.71 for 6 bits, so 5e-5 with 8 tables); what is found is compared exactly.

    Ids are hashes and a version is published once, so a replayed batch changes nothing. A
    failure in the graph part fails the batch and it is retried; a failure in the
    proposals is recorded and does not.
    """

    SCHEMAS = {
        "nodes": "id string, name string, name_key string, node_type string, weight double, ts timestamp_ntz, embedding array<float>",
        "ids": "id string, name_key string",
        "signs": "sign string, id string, name_key string, node_type string, embedding array<float>",
        "relationships": "id string, subject_id string, predicate string, object_id string, ts timestamp_ntz, content string, weight double",
        "evidence": "id string, target_id string",
        "links": "id string, target_id string",
        "hot_edges": HOT_EDGES,
        "proposals": "id string, question string, context string",
    }
    KEYS = {"nodes": "name_key", "signs": "sign", "evidence": ("id", "target_id"), "links": ("id", "target_id"), "hot_edges": "object_id"}

    def __init__(self, spark: SparkSession, root: str, embed=None, buckets: int = 16, tables: int = 8, bits: int = 6, slots: int = V.HOT_EDGE_SLOTS):
        self.spark, self.root, self.embed, self.buckets, self.tables, self.bits, self.slots = spark, root, embed, buckets, tables, bits, slots
        self.proposal_errors: list[str] = []

    def stored(self, name: str) -> Versioned:
        return Versioned(self.spark, f"{self.root}/{name}", f"{self.SCHEMAS[name]}, bucket int", "bucket")

    def table(self, name: str) -> DataFrame:
        return self.stored(name).read().drop("bucket")

    def proposals(self) -> DataFrame:
        return self.table("proposals")

    def _placed(self, name: str, rows: DataFrame) -> DataFrame:
        key = self.KEYS.get(name, "id")
        return rows.withColumn("bucket", bucket(F.struct(*key) if isinstance(key, tuple) else F.col(key), self.buckets))

    def _near(self, name: str, rows: DataFrame, before: int) -> tuple[DataFrame, list[int]]:
        """What is stored in the buckets that ``rows`` of the table fall into, and these buckets."""
        hit = touched(self._placed(name, rows))
        return self.stored(name).read(before=before, only=hit), hit

    def _signs(self, rows: DataFrame, probes: bool) -> DataFrame:
        """``rows(node_type, embedding, ..)`` once for each signature; with ``probes`` also for those with one sign turned."""
        signed = signatures(rows, self._dim(rows), self.tables, self.bits)
        if probes:
            turned = F.transform(F.sequence(F.lit(0), F.lit(self.bits - 1)), lambda i: F.col("bucket").bitwiseXOR(F.call_function("shiftleft", F.lit(1), i)))
            signed = signed.withColumn("bucket", F.explode(F.array_append(turned, F.col("bucket"))))
        return signed.withColumn("sign", F.concat_ws(":", "node_type", "bucket")).drop("bucket")

    def _dim(self, rows: DataFrame) -> int:
        return int(rows.agg(F.max(F.size("embedding"))).first()[0] or 0)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        """``batch`` holds (id, ts, text, owner)."""
        texts = batch.select("id", "ts", "text", "owner")
        triples = stage(
            outputs.canonical_triples(outputs.parse_triples(texts)).select(
                F.col("id").alias("entry_id"), "ts", "predicate",
                *[C.trim_ws(F.col(c)).alias(c) for c in ("subject", "object")], "subject_type", "object_type",
            ),
            "triples",
        )
        ends = triples.select(
            "entry_id", "ts", F.explode(F.array(
                F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("node_type")),
                F.struct(F.col("object").alias("name"), F.col("object_type").alias("node_type")),
            )).alias("e"),
        ).select("entry_id", "ts", "e.*")
        names = stage(ends.filter("name <> ''").groupBy("name", "node_type").agg(F.max("ts").alias("ts")), "names")
        ids, vectors = self._resolved(ends, names, batch_id)
        side = lambda end: ids.select(
            F.col("name").alias(end), F.col("node_type").alias(f"{end}_type"), F.col("id").alias(f"{end}_id")
        )
        observed = stage(
            triples.join(side("subject"), ["subject", "subject_type"]).join(side("object"), ["object", "object_type"])
            .select(
                "subject_id", "predicate", "object_id", "entry_id", "ts",
                C.relationship_id(F.col("subject_id"), F.col("predicate"), F.col("object_id")).alias("rel_id"),
            ),
            "observed",
        )
        self._write_nodes(ids, names, vectors, batch_id)

        known, hit = self._near("relationships", observed.select(F.col("rel_id").alias("id")), batch_id)
        no_links = self.spark.createDataFrame([], self.SCHEMAS["evidence"])
        relations, rel_evidence = merge.upsert_relationships(observed.drop("rel_id"), known, no_links, F.lit(None).cast("timestamp_ntz"))
        relations = relations.select("id", "subject_id", "predicate", "object_id", "ts", "content", "weight")
        self.stored("relationships").publish(self._placed("relationships", relations), batch_id, hit)

        seen = ends.join(ids, ["name", "node_type"]).select("id", F.col("entry_id").alias("target_id"))
        back = observed.select(F.explode(F.array("subject_id", "object_id", "entry_id")).alias("id"), F.col("rel_id").alias("target_id"))
        for name, added in (("evidence", rel_evidence.unionByName(seen)), ("links", back)):
            added = stage(added.distinct(), name)
            old, hit = self._near(name, added, batch_id)
            self.stored(name).publish(self._placed(name, merge.link_union(old, added)), batch_id, hit)

        edges = observed.select("object_id", F.col("rel_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seen_at"))
        old, hit = self._near("hot_edges", edges, batch_id)
        state = hot_edges_after(edges, old.drop("bucket"), self.slots)
        rest = old.drop("bucket").join(edges.select("object_id").distinct(), "object_id", "left_anti")
        self.stored("hot_edges").publish(self._placed("hot_edges", rest.unionByName(state)), batch_id, hit)
        try:
            asked = outputs.evaluator_fields(texts).filter(F.col("proposal").isNotNull())
            proposals = stage(asked.select("id", F.col("proposal").alias("question"), F.col("intent").alias("context")), "proposals")
            old, hit = self._near("proposals", proposals, batch_id)
            kept = old.drop("bucket").join(proposals.select("id"), "id", "left_anti").unionByName(proposals)
            self.stored("proposals").publish(self._placed("proposals", kept), batch_id, hit)
        except Exception as exc:
            self.proposal_errors.append(f"{batch_id}: {exc}")

    def _resolved(self, ends: DataFrame, names: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame | None]:
        """(name, node_type, id, how) of the batch's names, and their vectors (name, embedding)."""
        keyed = names.withColumn("name_key", F.lower("name"))
        given = names.filter(F.col("name").startswith("entity_")).select(F.col("name").alias("id"))
        named = self._near("ids", given, batch_id)[0].join(given.distinct(), "id", "left_semi").select("name_key")
        known = self._near("nodes", keyed.select("name_key").unionByName(named), batch_id)[0]
        known = known.select("id", "node_type", F.col("name").alias("content"), "embedding")
        vectors = None
        if self.embed is not None:
            vectors = self.embed(names.select("name").distinct().select(F.col("name").alias("id"), F.col("name").alias("text")))
            vectors = stage(vectors.filter(F.col("embedding").isNotNull()).select(F.col("id").alias("name"), "embedding"), "vectors")
            asked = self._signs(names.join(vectors, "name").select("node_type", "embedding"), probes=True).select("sign").distinct()
            asked = stage(asked, "signs")
            close = self._near("signs", asked, batch_id)[0].join(asked, "sign", "left_semi")
            close = close.groupBy("id").agg(F.first("node_type").alias("node_type"), F.first("embedding").alias("embedding"))
            close = close.join(known.select("id"), "id", "left_anti").select("id", "node_type", F.lit("").alias("content"), "embedding")
            known = stage(known.unionByName(close), "known")
        ids = merge.ensure_nodes(ends, known, vectors)
        return stage(ids.filter(F.col("id").isNotNull()).select("name", "node_type", "id", "how"), "ids"), vectors

    def _write_nodes(self, ids: DataFrame, names: DataFrame, vectors: DataFrame | None, batch_id: int) -> None:
        """Nodes of the batch: new ones with key and vector, seen ones with the time of the newest observation."""
        none = self.spark.createDataFrame([], "name string, embedding array<float>")
        seen = ids.join(names, ["name", "node_type"]).groupBy("id").agg(F.max("ts").alias("seen"))
        fresh = merge.new_nodes(ids, none if vectors is None else vectors).withColumn("name_key", F.lower("name"))
        fresh = stage(fresh.join(seen, "id"), "fresh")
        again = stage(ids.filter("how <> 'new'").select("id").distinct(), "again")
        keys = self._near("ids", again, batch_id)[0].join(again, "id", "left_semi").select("name_key")
        old, hit = self._near("nodes", fresh.select("name_key").unionByName(keys), batch_id)
        later = old.drop("bucket").join(seen, "id", "left").withColumn("ts", F.greatest("ts", "seen")).drop("seen")
        new = fresh.withColumnRenamed("seen", "ts").withColumn("weight", F.lit(V.WEIGHTS["entity"]))
        self.stored("nodes").publish(self._placed("nodes", later.unionByName(new.select(*later.columns))), batch_id, hit)
        old, hit = self._near("ids", fresh, batch_id)
        self.stored("ids").publish(self._placed("ids", old.select("id", "name_key").unionByName(fresh.select("id", "name_key"))), batch_id, hit)
        if vectors is not None:
            own = self._signs(fresh.filter(F.col("embedding").isNotNull()), probes=False).select("sign", "id", "name_key", "node_type", "embedding")
            own = stage(own, "own")
            old, hit = self._near("signs", own, batch_id)
            self.stored("signs").publish(self._placed("signs", old.select(*own.columns).unionByName(own)), batch_id, hit)


def hot_edges_after(batch: DataFrame, before: DataFrame, slots: int = V.HOT_EDGE_SLOTS) -> DataFrame:
    """(object_id, slot, id, score) of the objects in ``batch(object_id, id, seen_at)``, given their cache ``before``.

    An id that is present is refreshed to score 1. New ids, by time, take the free slots, then the slots scored
    below 1 from the lowest up; when every slot scores 1, each further id overwrites slot 1, so
    the last one stays there. Only the first ``slots`` new ids and the last row of an object can
    matter: a batch is cut to those in each task before the shuffle, however many rows one object has.
    """
    seen = stage(
        batch.groupBy("object_id", "id").agg(F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at")),
        "seen",
    )
    old = before.join(seen.select("object_id").distinct(), "object_id", "left_semi")
    again = seen.select("object_id", "id", F.lit(1.0).alias("fresh"))
    old = stage(
        old.join(again, ["object_id", "id"], "left")
        .select("object_id", "slot", "id", F.coalesce("fresh", "score").alias("score")),
        "cache",
    )
    fresh = seen.join(old.select("object_id", "id"), ["object_id", "id"], "left_anti")
    ranked = top_rows(fresh, ["object_id"], [F.asc("first_at"), F.asc("id")], slots, "r")
    low = F.array_sort(F.collect_list(F.when(F.col("score") < 1.0, F.struct("score", "slot"))))
    used = old.groupBy("object_id").agg(F.max("slot").alias("n"), low.alias("low"))
    counts = fresh.groupBy("object_id").agg(F.count(F.lit(1)).alias("new")).join(used, "object_id", "full")
    n = F.coalesce("n", F.lit(0))
    free = F.when(n < slots, F.sequence(n + 1, F.lit(slots))).otherwise(F.array().cast("array<int>"))
    targets = counts.select(
        "object_id",
        F.concat(free, F.coalesce(F.col("low.slot"), F.array().cast("array<int>"))).alias("targets"),
        F.coalesce("new", F.lit(0)).alias("new"),
    )
    placed = ranked.join(targets, "object_id").filter(F.col("r") <= F.size("targets")).select(
        "object_id", F.try_element_at("targets", F.col("r")).alias("slot"), "id", F.lit(1.0).alias("score")
    )
    kept = old.join(placed.select("object_id", "slot"), ["object_id", "slot"], "left_anti")
    state = stage(kept.unionByName(placed.select(*kept.columns)), "placed")
    full = targets.filter(F.col("new") > F.size("targets")).select("object_id")
    others = seen.join(full, "object_id", "left_semi").join(
        state.filter("slot > 1").select("object_id", "id"), ["object_id", "id"], "left_anti"
    )
    last = others.groupBy("object_id").agg(F.max_by("id", F.struct("last_at", "id")).alias("id")).select(
        "object_id", F.lit(1).alias("slot"), "id", F.lit(1.0).alias("score")
    )
    return state.join(last.select("object_id", "slot"), ["object_id", "slot"], "left_anti").select(*last.columns).unionByName(last)


class HotEdgesJob:
    """Bounded cache of relationship ids per object, kept by slot: (object_id, slot, id, score).

    Rows hold (object_id, id, seen_at); see ``hot_edges_after``. Objects lie in buckets: a batch
    reads and writes those it hits.
    """

    def __init__(self, spark: SparkSession, root: str, slots: int = V.HOT_EDGE_SLOTS, buckets: int = 16):
        self.spark, self.slots, self.buckets, self.root = spark, slots, buckets, root
        self.objects = Versioned(spark, f"{root}/objects", f"{HOT_EDGES}, bucket int", "bucket")

    def _placed(self, rows: DataFrame) -> DataFrame:
        rows = rows.select("object_id", F.col("slot").cast("int"), "id", "score")
        return rows.withColumn("bucket", bucket(F.col("object_id"), self.buckets))

    def seed(self, state: DataFrame) -> None:
        """The cache as it is before the first batch."""
        self.objects.publish(self._placed(state), -1)

    def state(self) -> DataFrame:
        return self.objects.read().drop("bucket")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        hit = touched(batch.select(bucket(F.col("object_id"), self.buckets).alias("bucket")))
        old = self.objects.read(before=batch_id, only=hit).drop("bucket")
        rest = old.join(batch.select("object_id").distinct(), "object_id", "left_anti")
        self.objects.publish(self._placed(rest.unionByName(hot_edges_after(batch, old, self.slots))), batch_id, hit)

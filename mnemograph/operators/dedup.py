"""Semantic and exact de-duplication of questions and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from mnemograph import schema as V
from mnemograph.functions import columns as C
from mnemograph.operators.vector import nearest
from mnemograph.session import stage

WINDOW_SECONDS = 30
#: A key is cut into spans of this many windows; each row is looked at in its own span and, near a border, in the next.
SPAN_WINDOWS = 120


def recent_questions(open_questions: DataFrame, answered: DataFrame, limit: int | None = None) -> DataFrame:
    """Open questions first, then answered ones, newest first; only the first ``limit`` when given."""
    cols = ["id", "question", "created"]
    both = open_questions.select(*cols, F.lit(0).alias("part")).unionByName(
        answered.select(*cols, F.lit(1).alias("part"))
    )
    rows = both.orderBy("part", F.desc("created"), "id")
    return (rows if limit is None else rows.limit(limit)).drop("part")


def semantic_anti_join(
    candidates: DataFrame, existing: DataFrame, similarity: float = V.QUESTION_SIMILARITY, **opts
) -> DataFrame:
    """Candidates(qid, embedding, ...) without an existing row at or above the similarity."""
    close = nearest(candidates, existing, 1, min_score=similarity, **opts)
    return candidates.join(close.select("qid"), "qid", "left_anti")


def similar_open_task(
    candidates: DataFrame, tasks: DataFrame, distance: float = V.TASK_DISTANCE, pool: int | None = None
) -> DataFrame:
    """Nearest pending or active task within the distance: (qid, id, score).

    With ``pool`` only the ``pool`` nearest tasks of any status are looked at.
    """
    is_open = F.col("status").isin("pending", "active")
    if pool is None:
        return nearest(candidates, tasks.filter(is_open), 1, min_score=1.0 - distance).select("qid", "id", "score")
    hits = nearest(candidates, tasks, pool, min_score=1.0 - distance)
    best = F.min_by(F.struct("id", "score"), F.col("rank"))
    return hits.join(tasks.filter(is_open).select("id"), "id").groupBy("qid").agg(best.alias("b")).select("qid", "b.id", "b.score")


def replay_tasks(tasks: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """What happens to each task(id, entry_id, content, ts): (id, created_id). Ids are unique.

    Rows of one entry and normalised content are taken in order of (time, id): a row is created
    unless the last created one is at most ``seconds`` older, which then is its created_id.
    Rows marked in an optional boolean column ``stored`` are created already. Rows without
    entry, content or time are created, always.

    A row is surely created when it is stored or no row of its key is at most ``seconds`` before it, and it
    decides all rows up to ``seconds`` behind it. What is left are rows in a longer row of
    repeats: the first one behind a sure row is created, and a created row is followed by the first row more than
    ``seconds`` later. These successors are a pointer table, and doubling the pointers marks
    the created rows. No key is one task: keys are cut into spans of time.
    """
    stored = F.coalesce("stored", F.lit(False)) if "stored" in tasks.columns else F.lit(False)
    norm = C.dedup_text(F.col("content"))
    rows = tasks.select(
        "id", "entry_id", norm.alias("norm"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), stored.alias("stored")
    )
    keyed = (F.coalesce("entry_id", F.lit("")) != "") & (F.coalesce("norm", F.lit("")) != "") & F.col("at").isNotNull()
    alone = rows.filter(~keyed).select("id", F.col("id").alias("created_id"))
    reach = seconds * 1_000_000
    marked = stage(_sure(rows.filter(keyed), reach), "sure")
    decided = marked.filter("created_id IS NOT NULL").select("id", "created_id").unionByName(alone)
    left = marked.filter("created_id IS NULL")
    if left.isEmpty():
        return decided
    created = _followed(_successors(left, reach)).filter("created").select("id", "created")
    return decided.unionByName(_last_created(left.join(created, "id", "left"), reach))


def _in_spans(rows: DataFrame, before: int, after: int, span: int) -> DataFrame:
    """``rows`` once in the ``span`` of their own (``own``) and in those they are near to."""
    first, last = F.floor((F.col("at") - after) / span), F.floor((F.col("at") + before) / span)
    placed = rows.withColumn("span", F.explode(F.sequence(first, last)))
    return placed.withColumn("own", F.col("span") == F.floor(F.col("at") / span))


def _sure(rows: DataFrame, reach: int) -> DataFrame:
    """(entry_id, norm, at, id, created_id, sure_id): ``created_id`` where a sure row decides it, ``sure_id`` the sure row up to two windows before.

    A span also sees the rows three windows before it: a sure row that matters for it lies within two
    windows, and the row that would make it unsure within one more. What seems sure further back is out of reach.
    """
    seen = _in_spans(rows, 3 * reach, 0, SPAN_WINDOWS * reach)
    forward = Window.partitionBy("entry_id", "norm", "span").orderBy("at", "id")
    behind = F.col("at") - F.lag("at").over(forward)
    seen = seen.withColumn("sure", F.when(F.col("stored") | behind.isNull() | (behind > reach), F.struct("at", "id")))
    last = F.last("sure", True).over(forward.rowsBetween(Window.unboundedPreceding, 0))
    seen = seen.withColumn("last", last).filter("own").withColumn("behind", F.col("at") - F.col("last.at"))
    return seen.select(
        "entry_id", "norm", "at", "id", F.when(F.col("behind") <= reach, F.col("last.id")).alias("created_id"),
        F.when(F.col("behind") <= 2 * reach, F.col("last.id")).alias("sure_id"),
    )


def _successors(left: DataFrame, reach: int) -> DataFrame:
    """(id, following, created) of undecided rows: the row that is created next if this one is; the first ones are.

    A successor lies within two windows and has no sure row between, or there is none. It is
    read off one order of the rows and of probes one window behind each row.
    """
    seen = _in_spans(left, 0, 2 * reach, SPAN_WINDOWS * reach)
    probes = F.array(F.struct(F.lit(0).alias("probe"), F.col("at").alias("when")), F.struct(F.lit(1).alias("probe"), (F.col("at") + reach).alias("when")))
    mixed = seen.withColumn("p", F.explode(probes)).select("*", "p.*")
    backward = Window.partitionBy("entry_id", "norm", "span").orderBy(F.desc("when"), F.desc("probe"), F.desc("id"))
    row = F.struct("at", "id", "sure_id")
    later = F.last(F.when(F.col("probe") == 0, row), True).over(backward.rowsBetween(Window.unboundedPreceding, -1))
    found = mixed.withColumn("later", later).filter((F.col("probe") == 1) & F.col("own"))
    # A row behind a sure one that is not this row's belongs to that one.
    same = F.col("later.sure_id").isNull() | F.col("later.sure_id").eqNullSafe(F.col("sure_id"))
    following = F.when(same & (F.col("later.at") - F.col("at") <= 2 * reach), F.col("later.id"))
    firsts = left.filter("sure_id IS NOT NULL").groupBy("sure_id").agg(F.min(F.struct("at", "id"))["id"].alias("id")).select("id", F.lit(True).alias("created"))
    links = found.select("id", following.alias("following")).join(firsts, "id", "left")
    return stage(links.select("id", "following", F.coalesce("created", F.lit(False)).alias("created")), "pointers")


def _followed(links: DataFrame) -> DataFrame:
    """``links(id, following, created)`` with ``created`` set wherever pointers lead from a created row.

    Each round the created rows mark where their pointer leads, and each pointer takes the place
    of the two it leads over: after n rounds 2^n rows of a chain are marked.
    """
    now = links
    while not now.filter("created AND following IS NOT NULL").isEmpty():
        targets = now.filter("created AND following IS NOT NULL").select(F.col("following").alias("id"), F.lit(True).alias("hit"))
        further = now.select(F.col("id").alias("following"), F.col("following").alias("next"))
        step = now.join(targets, "id", "left").join(further, "following", "left")
        now = stage(step.select("id", F.col("next").alias("following"), (F.col("created") | F.coalesce("hit", F.lit(False))).alias("created")), "pointers")
    return now


def _last_created(rows: DataFrame, reach: int) -> DataFrame:
    """(id, created_id) of ``rows(entry_id, norm, at, id, created)``: the last created row, at most ``reach`` before."""
    forward = Window.partitionBy("entry_id", "norm", "span").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("created"), F.col("id")), True).over(forward)
    return _in_spans(rows, reach, 0, SPAN_WINDOWS * reach).withColumn("created_id", last).filter("own").select("id", "created_id")


def recent_duplicate_task(tasks: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Tasks that repeat a created one within ``seconds``: (id, duplicate_of), the latter created."""
    return replay_tasks(tasks, seconds).filter("id <> created_id").select("id", F.col("created_id").alias("duplicate_of"))


def merge_neighbours(parts: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Union of (qid, id) lists: the first list a row appears in wins, the root itself is left out."""
    tagged = [p.select("qid", "id", F.lit(i).alias("part")) for i, p in enumerate(parts)]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    first = out.filter(F.col("id") != "").groupBy("qid", "id").agg(F.min("part").alias("part"))
    return first.join(roots.select("qid", "id"), ["qid", "id"], "left_anti")


def create_tasks(new: DataFrame, tasks: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Outcome per new task(id, entry_id, content, status, ts, embedding): (id, action, surviving_id).

    ``repeat`` when the same entry and text was created within ``seconds``, ``similar`` when an
    open task is close, else ``create``. A repeat survives as what its first task became.
    """
    repeats = recent_duplicate_task(new, seconds)
    rest = new.join(repeats.select("id"), "id", "left_anti")
    close = similar_open_task(rest.select(F.col("id").alias("qid"), "embedding"), tasks).select(
        F.col("qid").alias("id"), F.col("id").alias("similar_id")
    )
    of_first = close.select(F.col("id").alias("duplicate_of"), F.col("similar_id").alias("first_similar_id"))
    return (
        new.select("id")
        .join(repeats, "id", "left")
        .join(close, "id", "left")
        .join(of_first, "duplicate_of", "left")
        .select(
            "id",
            F.when(F.col("duplicate_of").isNotNull(), "repeat").when(F.col("similar_id").isNotNull(), "similar").otherwise("create").alias("action"),
            F.coalesce("first_similar_id", "duplicate_of", "similar_id", "id").alias("surviving_id"),
        )
    )

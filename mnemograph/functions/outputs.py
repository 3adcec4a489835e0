"""Model output text as tables: key/value lines, sections, triples, subtasks, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemograph.functions import columns as C

# a line "key: value" or "section:"; the key is made of letters, digits and underscores
KEY_LINE = r"^([A-Za-z0-9_]+)\s*:\s*(.*)$"


def _lines(text: Column) -> Column:
    """Trimmed non-empty lines as struct(line, key, value, section).

    ``section`` is the section a line without a key belongs to: a fold over the lines
    carries the section that is open.
    """
    trimmed = F.filter(F.transform(F.split(text, "\n"), C.trim_ws), lambda x: x != "")
    parsed = F.transform(
        trimmed,
        lambda x: F.struct(
            x.alias("line"),
            F.lower(F.regexp_extract(x, KEY_LINE, 1)).alias("key"),
            F.regexp_extract(x, KEY_LINE, 2).alias("value"),
        ),
    )
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("sections"))

    def step(acc: Column, x: Column) -> Column:
        has_key = x["key"] != ""
        now_open = F.when(has_key, F.when(x["value"] == "", x["key"]).otherwise("")).otherwise(acc["open"])
        own = F.when(has_key, F.lit("")).otherwise(acc["open"])
        return F.struct(now_open.alias("open"), F.array_append(acc["sections"], own).alias("sections"))

    def with_sections(rows: Column) -> Column:
        sections = F.aggregate(rows, start, step, lambda acc: acc["sections"])
        return F.zip_with(
            rows,
            sections,
            lambda x, s: F.struct(x["line"].alias("line"), x["key"].alias("key"), x["value"].alias("value"), s.alias("section")),
        )

    return C.bind(parsed, with_sections)


def _numbered(lines: Column, name: str | None) -> Column:
    """Section lines as struct(key, pos, value), ``pos`` counting within the section."""

    def number(own: Column) -> Column:
        return F.transform(
            own,
            lambda x, i: F.struct(
                x["section"].alias("key"),
                F.size(F.filter(F.slice(own, F.lit(1), i + 1), lambda y: y["section"] == x["section"])).alias("pos"),
                x["line"].alias("value"),
            ),
        )

    wanted = F.filter(lines, lambda x: (x["section"] != "") if name is None else (x["section"] == name))
    return C.bind(wanted, number)


def parse_kv(texts: DataFrame, text: str = "text") -> DataFrame:
    """Long table (id, key, pos, value, is_section).

    A plain key keeps its last value; section lines are numbered from 1; other text is
    dropped. One explode per row, nothing is shuffled.
    """

    def entries(lines: Column) -> Column:
        plain = F.filter(lines, lambda x: (x["key"] != "") & (x["value"] != ""))
        last = F.filter(
            plain,
            lambda x, i: ~F.exists(F.slice(plain, i + 2, F.size(plain)), lambda y: y["key"] == x["key"]),
        )
        simple = F.transform(
            last,
            lambda x: F.struct(
                x["key"].alias("key"), F.lit(1).alias("pos"), x["value"].alias("value"), F.lit(False).alias("is_section")
            ),
        )
        sections = F.transform(
            _numbered(lines, None),
            lambda x: F.struct(
                x["key"].alias("key"), x["pos"].alias("pos"), x["value"].alias("value"), F.lit(True).alias("is_section")
            ),
        )
        return F.concat(simple, sections)

    rows = texts.select("id", F.explode(C.bind(_lines(F.col(text)), entries)).alias("e"))
    return rows.select("id", "e.key", "e.pos", "e.value", "e.is_section")


def _last_value(lines: Column, key: str) -> Column:
    hits = F.filter(lines, lambda x: (x["key"] == key) & (x["value"] != ""))
    return F.try_element_at(F.transform(hits, lambda x: x["value"]), F.lit(-1))


def simple_value(text: Column, key: str) -> Column:
    """Last value of a plain key, null when absent."""
    return _last_value(_lines(text), key)


def section_lines(texts: DataFrame, name: str | None, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ..., key, pos, value) for the lines of one section, or of all sections."""
    numbered = C.bind(_lines(F.col(text)), lambda lines: _numbered(lines, name))
    return texts.select("id", *keep, F.explode(numbered).alias("s")).select("id", *keep, "s.key", "s.pos", "s.value")


def parse_triples(texts: DataFrame, text: str = "text", owner: str = "owner") -> DataFrame:
    """Triples of the ``triples`` section, bad lines included with their error."""
    keep = tuple(c for c in ("ts", owner) if c in texts.columns)
    lines = section_lines(texts, "triples", text, keep)
    triple = C.parse_triple(F.col("value"), F.col(owner))
    return lines.select("id", *[k for k in keep if k != owner], "pos", triple.alias("t")).select(
        "id", *[k for k in keep if k != owner], "pos", "t.*"
    )


def canonical_triples(triples: DataFrame) -> DataFrame:
    """Accepted triples with canonical predicates; ``in_ontology`` tells known ones apart."""
    new = C.proposed_predicate(F.col("predicate"))
    pred = C.canonical_predicate(F.coalesce(new, F.col("predicate")))
    rows = triples.filter(F.col("error").isNull()).withColumn("proposed", new).withColumn("predicate", pred)
    return rows.filter(F.col("predicate") != "").withColumn(
        "in_ontology", C.snap_predicate(F.col("predicate")).isNotNull()
    )


def parse_subtasks(texts: DataFrame, text: str = "text") -> DataFrame:
    """Child tasks of "title | description | dep, dep" lines: (id, pos, content, dependencies, is_sequential)."""
    sequential = F.lower(C.text_or_empty(simple_value(F.col(text), "is_sequential"))) == "true"
    lines = section_lines(texts.withColumn("is_sequential", sequential), "subtasks", text, ("is_sequential",))
    parts = F.split("value", r" \| ", 3)
    at = lambda i: C.trim_ws(C.text_or_empty(F.get(parts, F.lit(i))))
    deps = F.filter(F.transform(F.split(at(2), ","), C.trim_ws), lambda d: d != "")
    content = F.when(at(1) != "", F.concat(at(0), F.lit(": "), at(1))).otherwise(at(0))
    return lines.filter(F.size(parts) >= 2).select(
        "id", "pos", content.alias("content"), deps.alias("dependencies"), "is_sequential"
    )


def parse_questions(texts: DataFrame, text: str = "text") -> DataFrame:
    """(id, pos, question, reason) of "question | reason: ..." lines."""
    lines = section_lines(texts, "questions", text)
    parts = F.split("value", r" \| reason: ", 2)
    return lines.select(
        "id", "pos", C.trim_ws(F.get(parts, F.lit(0))).alias("question"),
        C.trim_ws(C.text_or_empty(F.get(parts, F.lit(1)))).alias("reason"),
    ).filter(F.col("question") != "")


def evaluator_fields(texts: DataFrame, text: str = "text", commitment: float = 0.6, min_bytes: int = 10) -> DataFrame:
    """(id, significance, domain, future_commitment, intent, proposal); scores clamped to 0..1.

    ``proposal`` is the question to ask when the commitment is strong and the intent is specific.
    """

    def fields(lines: Column) -> Column:
        number = lambda key: F.greatest(
            F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_last_value(lines, key).try_cast("double"), F.lit(0.0)))
        )
        return F.struct(
            number("significance").alias("significance"),
            F.coalesce(_last_value(lines, "domain"), F.lit("thought")).alias("domain"),
            number("future_commitment").alias("future_commitment"),
            C.text_or_empty(_last_value(lines, "commitment_intent")).alias("intent"),
        )

    out = texts.select("id", C.bind(_lines(F.col(text)), fields).alias("f")).select("id", "f.*")
    strong = (F.col("future_commitment") >= commitment) & (F.octet_length("intent") >= min_bytes)
    ask = F.concat(F.lit('Should I create a task for: "'), "intent", F.lit('"?'))
    return out.withColumn("proposal", F.when(strong, ask))

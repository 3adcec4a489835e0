"""Column expressions for text, triples, statuses, ids and metadata."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, functions as F

from mnemograph import schema as V

def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """Value of a fixed map, null when absent."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    return F.try_element_at(table, key)


def inverted(groups: dict[str, list[str]]) -> dict[str, str]:
    return {word: name for name, words in groups.items() for word in words}


def any_of(words: list[str]) -> str:
    """Regex alternation of literal words."""
    return "|".join(re.escape(w) for w in words)


def ltrim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+", "")


def trim_ws(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, r"\s+", " "))


# predicates, types, statuses, ids


def normalise_predicate(c: Column) -> Column:
    return F.translate(F.lower(trim_ws(c)), " -", "__")


def canonical_predicate(c: Column) -> Column:
    p = normalise_predicate(c)
    return F.coalesce(lookup(V.PREDICATE_ALIASES, p), p)


def snap_predicate(c: Column) -> Column:
    p = canonical_predicate(c)
    return F.when(p.isin(V.PREDICATES), p)


def canonical_type(c: Column) -> Column:
    return F.coalesce(lookup(inverted(V.ENTITY_TYPES), trim_ws(F.lower(c))), F.lit("generic"))


def entity_status(c: Column) -> Column:
    known = lookup(inverted(V.ENTITY_STATUSES), F.lower(trim_ws(c)))
    return F.coalesce(known, F.when(text_or_empty(c) == "", "In-Progress"), c)


def task_status(c: Column) -> Column:
    return F.when(c.isin(V.TASK_STATUSES), c).otherwise("pending")


def entity_id(node_type: Column, name: Column) -> Column:
    return F.concat(F.lit("entity_"), F.sha1(F.concat_ws(":", node_type, F.lower(trim_ws(name)))))


def relationship_id(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.concat(F.lit("rel_"), F.sha1(F.concat_ws(":", subject, predicate, obj)))


def resolve_pronoun(term: Column, owner: Column) -> Column:
    """Owner name for a pronoun, null when the owner is unknown, else the term."""
    owner_known = F.when(text_or_empty(owner) != "", owner)
    return F.when(F.lower(term).isin(V.PRONOUNS), owner_known).otherwise(term)


# triples


def parse_triple(line: Column, owner: Column) -> Column:
    """struct(subject, predicate, object, subject_type, object_type, raw_line, error)."""
    parts = F.transform(F.split(line, r"\|", -1), trim_ws)
    n = F.size(parts)
    field = lambda i: text_or_empty(F.get(parts, F.lit(i)))
    sub, pred, obj = field(0), field(1), field(2)
    who, whom = resolve_pronoun(sub, owner), resolve_pronoun(obj, owner)
    shape = F.when(
        ~n.isin(3, 5),
        F.concat(F.lit("expected 3 or 5 pipe-separated fields, got "), n.cast("string")),
    )
    empty = F.when(
        (sub == "") | (pred == "") | (obj == ""), "subject, predicate, and object must all be non-empty"
    )
    pronoun = F.when(
        who.isNull() | whom.isNull(), "pronoun subject or object rejected (owner identity unknown)"
    )
    error = F.coalesce(shape, empty, pronoun)
    ok = error.isNull()
    kept = lambda c: F.when(shape.isNull(), c)
    type_of = lambda i: F.when(ok, F.when(n == 5, canonical_type(field(i))).otherwise("generic"))
    return F.struct(
        kept(F.coalesce(F.when(ok, who), sub)).alias("subject"),
        kept(pred).alias("predicate"),
        kept(F.coalesce(F.when(ok, whom), obj)).alias("object"),
        type_of(3).alias("subject_type"),
        type_of(4).alias("object_type"),
        trim_ws(line).alias("raw_line"),
        error.alias("error"),
    )


def parse_fact(line: Column) -> Column:
    """Lenient subject | predicate | object: further pipes stay in the object; null when unusable."""
    parts = F.transform(F.split(line, r"\|", 3), trim_ws)
    usable = (F.size(parts) == 3) & F.forall(parts, lambda p: p != "")
    return F.when(
        usable,
        F.struct(
            F.get(parts, F.lit(0)).alias("subject"),
            F.get(parts, F.lit(1)).alias("predicate"),
            F.get(parts, F.lit(2)).alias("object"),
        ),
    )


def proposed_predicate(c: Column) -> Column:
    """Normalised predicate of a NEW: proposal, else null."""
    bare = normalise_predicate(F.regexp_replace(c, "^(NEW:|new:)", ""))
    return F.when(F.upper(c).startswith("NEW:") & (bare != ""), bare)


# predicates on text


def explicit_override(c: Column) -> Column:
    text = F.lower(trim_ws(c))
    return text.rlike(any_of(V.OVERRIDE_MARKERS)) | text.rlike(f"^({any_of(V.OVERRIDE_PREFIXES)})")


def affirmative(c: Column) -> Column:
    return F.lower(trim_ws(c)).rlike(rf"\A({any_of(V.AFFIRMATIVES)})( |\z)")


def gap_in_thought(c: Column) -> Column:
    after = F.regexp_extract(F.lower(text_or_empty(c)), r"(?s)identified gaps:(.*)", 1)
    lines = F.transform(F.split(after, "\n"), lambda x: trim_ws(F.regexp_replace(x, "^[-*• \t]+", "")))
    first = F.get(F.filter(lines, lambda x: x != ""), F.lit(0))
    return F.coalesce(~first.isin(V.NO_GAP_WORDS), F.lit(False))


def gap_in_result(c: Column) -> Column:
    return F.lower(text_or_empty(c)).rlike(any_of(V.NOT_FOUND_PHRASES))


def decision_line(c: Column) -> Column:
    return F.lower(c).rlike(any_of(V.DECISION_MARKERS))


def proper_nouns(c: Column) -> Column:
    """Lower-cased words of at least three bytes that start with an ASCII capital."""
    bare = F.transform(F.split(c, r"\s+"), lambda w: F.regexp_replace(w, r"^[.,!?;:\"'()\[\]{}]+|[.,!?;:\"'()\[\]{}]+$", ""))
    named = F.filter(bare, lambda w: (F.octet_length(w) >= 3) & w.rlike("^[A-Z]"))
    return F.array_distinct(F.transform(named, F.lower))


# cleaning


def valid_utf8(binary: Column) -> Column:
    """Text of a binary column without undecodable bytes."""
    return F.replace(F.make_valid_utf8(binary.cast("string")), F.lit("�"), F.lit(""))


def cut_runes(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def cut_bytes(c: Column, n: int) -> Column:
    """At most ``n`` bytes without splitting a character."""
    head = F.substring(c.cast("binary"), 1, n).cast("string")
    cut = F.rtrim(F.make_valid_utf8(head), F.lit("�"))
    return F.when(F.octet_length(c) <= n, c).otherwise(cut)


def strip_done(c: Column) -> Column:
    """Drop a trailing "done" or "done."; text without one is returned untouched."""
    trimmed = trim_ws(c)
    ends = F.lower(trimmed).rlike(r"done\.?\z")
    return F.when(ends, trim_ws(F.regexp_replace(trimmed, r"(?i)done\.?\z", ""))).otherwise(c)


def dedup_text(c: Column) -> Column:
    return collapse_ws(F.lower(c))


def page_text(html: Column, max_bytes: int | None = None) -> Column:
    """Readable text of a page: scripts, styles and tags removed, entities decoded."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>", "")
    bare = F.regexp_replace(bare, r"(?is)<style.*?</style>", "")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    text = collapse_ws(bare)
    if max_bytes is None:
        return text
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(
        F.concat(cut_bytes(text, max_bytes), F.lit("...[truncated]"))
    )


def image_token_id(c: Column) -> Column:
    found = trim_ws(F.regexp_extract(c, r"\[SEND_IMAGE:([^\]]*)\]", 1))
    return F.when(found != "", found)


def image_caption(c: Column) -> Column:
    """Text without its first image token; null when there is none."""
    around = F.split(c, r"\[SEND_IMAGE:[^\]]*\]", 2)
    return F.when(image_token_id(c).isNotNull(), trim_ws(F.array_join(around, "")))


def image_tokens_as_sent(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, r"\[SEND_IMAGE:[^\]]+\]", "[Photo sent]"))


def missing_info(c: Column) -> Column:
    """struct(answer, missing): split MISSING_INFO lines out of an answer."""
    raw = trim_ws(text_or_empty(c))
    lines = F.split(raw, "\n")
    marker = r"(?i)^\s*missing_info\s*:\s*(.*)$"
    values = F.filter(
        F.transform(lines, lambda x: trim_ws(F.regexp_extract(x, marker, 1))), lambda v: v != ""
    )
    last = text_or_empty(F.try_element_at(values, F.lit(-1)))
    items = F.filter(F.transform(F.split(last, ";"), trim_ws), lambda v: v != "")
    kept = F.filter(lines, lambda x: ~F.upper(trim_ws(x)).startswith("MISSING_INFO:"))
    answer = trim_ws(F.array_join(kept, "\n"))
    return F.struct(
        F.when((last == "") | (answer == ""), raw).otherwise(answer).alias("answer"), items.alias("missing")
    )


# metadata


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def variant_of(metadata: Column) -> Column:
    """Parsed metadata; blank or broken JSON counts as an empty object."""
    return F.coalesce(F.try_parse_json(metadata), F.parse_json(F.lit("{}")))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def string_field(doc: Column, key: str) -> Column:
    """A field when it is a non-empty JSON string, else null."""
    path = f"$.{key}"
    is_text = _kind(F.try_variant_get(doc, path, "variant")) == "STRING"
    return F.when(is_text, F.nullif(F.try_variant_get(doc, path, "string"), F.lit("")))


def metadata_string(metadata: Column, key: str) -> Column:
    """A metadata field when it is a non-empty JSON string, else null."""
    return bind(variant_of(metadata), lambda doc: string_field(doc, key))


def _strings(doc: Column, key: str) -> Column:
    items = F.try_variant_get(doc, f"$.{key}", "array<variant>")
    texts = F.transform(F.filter(items, lambda x: _kind(x) == "STRING"), lambda x: x.cast("string"))
    return F.when(F.size(texts) > 0, texts)


def _raw(doc: Column, key: str) -> Column:
    return F.try_variant_get(doc, f"$.{key}", "variant")


def _lower(doc: Column, key: str) -> Column:
    return F.lower(string_field(doc, key))


def _parent(doc: Column) -> Column:
    return F.coalesce(*[string_field(doc, k) for k in ("parent_goal", "parent_goal_id", "project_id", "project_uuid")])


def _number(doc: Column, key: str) -> Column:
    path = f"$.{key}"
    kind = _kind(F.try_variant_get(doc, path, "variant"))
    numeric = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(doc, path, "double"))


# The words allowed per type and field, and what the message calls the type.
ALLOWED = {
    "project": {"status": ("project/goal", V.PROJECT_STATUSES)},
    "goal": {"status": ("project/goal", V.PROJECT_STATUSES)},
    "preference": {
        "category": ("preference", ["food", "workflow", "tech"]),
        "sentiment": ("preference", ["like", "dislike", "rigid"]),
    },
    "event": {"type": ("event/milestone", ["celebration", "work", "health"])},
    "milestone": {"type": ("event/milestone", ["celebration", "work", "health"])},
    "place": {"category": ("place", ["home", "office", "travel"])},
    "asset": {"type": ("asset/tool", ["software", "hardware", "account"])},
    "tool": {"type": ("asset/tool", ["software", "hardware", "account"])},
    "user_identity": {"category": ("user_identity", ["name", "role", "value", "trait"])},
}

_text = lambda key: lambda m: string_field(m, key)
_word = lambda key: lambda m: _lower(m, key)
_list = lambda key: lambda m: _strings(m, key)
_any = lambda key: lambda m: _raw(m, key)

_PROJECT = {
    "parent_goal": _parent, "project_id": _parent, "project_uuid": _parent, "status": _word("status"),
    "deadline": _text("deadline"), "archive_summary": _text("archive_summary"),
    "step_number": _any("step_number"), "dependencies": _any("dependencies"),
}
_EVENT = {"date": _text("date"), "type": _word("type"), "attendees": _list("attendees")}
_ASSET = {"type": _word("type"), "configuration": _any("configuration"), "preferences": _any("preferences")}

# Output fields per registered type, each a function of the parsed metadata. Callers may add types; a type that is absent passes unchanged.
REGISTRY = {
    "person": {
        "relationship_strength": _text("relationship_strength"), "occupation": _text("occupation"),
        "birthdate": _text("birthdate"), "last_interaction": _text("last_interaction"),
        "interests": _list("interests"),
    },
    "project": _PROJECT,
    "goal": _PROJECT,
    "preference": {"subject": _text("subject"), "category": _word("category"), "sentiment": _word("sentiment")},
    "event": _EVENT,
    "milestone": _EVENT,
    "place": {"address": _text("address"), "category": _word("category"), "notes": _text("notes")},
    "asset": _ASSET,
    "tool": _ASSET,
    "object": {"source_excerpt": _text("source_excerpt"), "tags": _list("tags")},
    "response": {"logic_trace": _text("logic_trace"), "source_entry_uuid": _text("source_entry_uuid")},
    "summary": {"level": lambda m: _number(m, "level").cast("int")},
    "generic": {
        "source_excerpt": _text("source_excerpt"), "extracted_facts": _list("extracted_facts"),
        "confidence_score": lambda m: F.coalesce(_number(m, "confidence_score"), F.lit(0.0)),
        "tags": _list("tags"),
    },
    "user_identity": {"category": _word("category")},
}


def validate_metadata(node_type: Column, metadata: Column) -> Column:
    """Error text of the first broken rule, or null."""

    def check(doc: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, rules in ALLOWED.items():
            errors = []
            for field, (label, words) in rules.items():
                value = string_field(doc, field)
                message = F.concat(F.lit(f'invalid {field} "'), value, F.lit(f'" for {label}'))
                errors.append(F.when(~F.lower(value).isin(words), message))
            out = F.when(node_type == kind, F.coalesce(*errors)).otherwise(out)
        return out

    return bind(variant_of(metadata), check)


def normalise_metadata(node_type: Column, metadata: Column, registry: dict | None = None) -> Column:
    """Metadata reduced to the fields of its type, as JSON with sorted keys; other types unchanged."""

    def reduce(doc: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, fields in (registry or REGISTRY).items():
            body = F.to_json(F.struct(*[fields[k](doc).alias(k) for k in sorted(fields)]))
            out = F.when(node_type == kind, body).otherwise(out)
        return out

    return F.coalesce(bind(variant_of(metadata), reduce), metadata)


def parse_analysis(raw: Column, entry_id: Column) -> Column:
    """Nested analysis of an entry: source ids filled in, statuses normalised; bad JSON gives null."""
    schema = V.T.StructType(V.ANALYSIS.fields + [V.T.StructField("_bad", V.S)])

    def fill(doc: Column) -> Column:
        entities = F.transform(
            doc["entities"],
            lambda e: F.struct(
                e["name"].alias("name"),
                e["type"].alias("type"),
                entity_status(text_or_empty(e["status"])).alias("status"),
                F.coalesce(F.nullif(e["source_id"], F.lit("")), entry_id).alias("source_id"),
            ),
        )
        plain = [doc[f].alias(f) for f in ("summary", "mood", "category", "tags", "open_loops")]
        return F.when(doc["_bad"].isNull() & raw.isNotNull(), F.struct(*plain, entities.alias("entities")))

    return bind(F.from_json(raw, schema, {"columnNameOfCorruptRecord": "_bad"}), fill)


# text statistics, units, codes, prices


def text_stats(c: Column) -> dict[str, Column]:
    words = F.regexp_count(c, F.lit(r"\S+"))
    ends = F.regexp_count(c, F.lit("[.!?]+"))
    # a blank line between two visible characters starts a paragraph
    breaks = F.regexp_count(c, F.lit(r"\n\n\s*(?=\S)"))
    leading = c.rlike(r"\A\s*?\n\n\s*(?=\S)").cast("int")
    return {
        "n_bytes": F.octet_length(c),
        "n_bytes_no_space": F.octet_length(F.replace(c, F.lit(" "), F.lit(""))),
        "n_words": words,
        "n_sentences": F.when((ends == 0) & (words > 0), 1).otherwise(ends),
        "n_paragraphs": F.when(words > 0, breaks + 1 - leading).otherwise(0),
        "minutes": words / F.lit(200.0),
    }


def convert_unit(value: Column, source: Column, target: Column) -> Column:
    """Value in the target unit; null for unknown units or different dimensions."""
    def part(i: int, key: Column) -> Column:
        names = {name: spec[i] for group, spec in V.UNITS.items() for name in group}
        table = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
        return F.try_element_at(table, F.lower(trim_ws(key)))

    base = value * part(1, source) + part(2, source)
    return F.when(part(0, source) == part(0, target), (base - part(2, target)) / part(1, target))


def weather_label(code: Column) -> Column:
    flat = {c: label for lo, hi, label in V.WEATHER_CODES for c in range(lo, hi + 1)}
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(flat.items())])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("Unknown"))


def zone_of(alias: Column) -> Column:
    """Time zone id of an alias; other names pass through."""
    name = F.lower(trim_ws(alias))
    return F.coalesce(lookup(V.ZONES, name), name)


def price_key(model: Column, prices: dict | None = None, default: str = V.DEFAULT_MODEL) -> Column:
    """Name in the price list: exact, else longest listed prefix, else a listed longer name, else the default."""
    names = sorted(prices or V.MODEL_PRICES, key=lambda n: (-len(n), n))
    key = F.regexp_replace(F.coalesce(F.nullif(model, F.lit("")), F.lit(default)), "^.*/", "")
    exact = F.when(key.isin(names), key)
    longer = [F.when(key.startswith(n), n) for n in names]
    shorter = [F.when(F.startswith(F.lit(n), key), n) for n in reversed(names)]
    return F.coalesce(exact, *longer, *shorter, F.lit(default))


def call_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict | None = None) -> Column:
    prices = prices or V.MODEL_PRICES
    rate = lambda i: F.create_map(*[F.lit(x) for n, p in prices.items() for x in (n, p[i])])
    key = price_key(model, prices)
    return tokens_in / 1e6 * F.element_at(rate(0), key) + tokens_out / 1e6 * F.element_at(rate(1), key)


def temporal_bias(score: Column, ts: Column, as_of: Column, half_life_days: float = V.HALF_LIFE_DAYS) -> Column:
    """score * 2^(-age / half life); an unknown time leaves the score unchanged."""
    age = F.greatest(F.lit(0.0), seconds_between(ts, as_of) / 86400.0)
    return F.when(ts.isNull(), score).otherwise(score * F.exp(-F.log(F.lit(2.0)) / half_life_days * age))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6

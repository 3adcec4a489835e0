"""Column functions against tables of cases."""

import json

import pytest
from pyspark.sql import functions as F

from mnemograph.functions import columns as C, dates, outputs


def cases(apply, fn, table, kind="string"):
    got = apply(fn, [raw for raw, _ in table], kind)
    assert got == [want for _, want in table]


def test_predicates(apply):
    cases(apply, C.normalise_predicate, [
        ("works at", "works_at"), ("Works At", "works_at"), ("works-at", "works_at"), ("  prefers ", "prefers"),
        ("LIVES_IN", "lives_in"), ("is a", "is_a"), ("", ""), ("reports - to", "reports___to"),
    ])
    cases(apply, C.canonical_predicate, [
        ("works for", "works_at"), ("employed-by", "works_at"), ("Based In", "located_in"), ("loves", "loves"), ("manage", "manages"),
    ])
    cases(apply, C.snap_predicate, [
        ("works at", "works_at"), ("resides in", "lives_in"), ("collaborates", "collaborates_with"), ("loves", None), ("", None), ("owns", "owns"),
    ])


def test_entity_types(apply):
    cases(apply, C.canonical_type, [
        ("Person", "person"), ("Place", "place"), ("location", "place"), ("Project", "project"), ("tool", "tool"),
        ("unknown", "generic"), ("", "generic"), ("object", "asset"), (" hotel ", "place"), ("trip", "event"),
    ])


def test_statuses(apply):
    cases(apply, C.entity_status, [
        ("planning", "Planned"), ("In Progress", "In-Progress"), (" blocked ", "Stalled"), ("Done", "Completed"), ("", "In-Progress"), ("odd", "odd"),
    ])
    cases(apply, C.task_status, [
        ("pending", "pending"), ("active", "active"), ("completed", "completed"), ("abandoned", "abandoned"), ("Active", "pending"), ("", "pending"),
    ])


def test_fact_lines(apply):
    got = apply(C.parse_fact, [
        "Sam | works at | Acme", "no pipe", "one | pipe", "a | b | c | d", " x |y| z ", "| b | c", "a || c", "a | b | ", "",
    ])
    assert [tuple(r) if r else None for r in got] == [
        ("Sam", "works at", "Acme"), None, None, ("a", "b", "c | d"), ("x", "y", "z"), None, None, None, None,
    ]


def test_triple_lines(spark):
    rows = [
        (0, "Ann | works at | Acme | person | work", ""), (1, "bad line", ""), (2, "Ann | likes | tea", ""),
        (3, "I | live in | Rome", ""), (4, "I | live in | Rome", "Ann"), (5, "a | b | c | d", ""), (6, "a |  | c", ""),
    ]
    df = spark.createDataFrame(rows, "i int, line string, owner string")
    got = [r.t for r in df.select("i", C.parse_triple(F.col("line"), F.col("owner")).alias("t")).orderBy("i").collect()]
    assert (got[0].subject, got[0].subject_type, got[0].object_type, got[0].error) == ("Ann", "person", "project", None)
    assert got[1].raw_line == "bad line" and got[1].error == "expected 3 or 5 pipe-separated fields, got 1"
    assert (got[2].subject_type, got[2].object_type) == ("generic", "generic")
    assert got[3].error == "pronoun subject or object rejected (owner identity unknown)"
    assert got[4].subject == "Ann" and got[4].error is None
    assert got[5].error.endswith("got 4") and got[6].error.startswith("subject, predicate")


def test_new_predicates(apply):
    cases(apply, C.proposed_predicate, [("NEW:Mentors", "mentors"), ("new: is afraid-of", "is_afraid_of"), ("owns", None), ("NEW:", None)])


def test_ids(apply):
    got = apply(lambda v: C.entity_id(F.lit("person"), v), ["Ann", " ann ", "Bob"])
    assert got[0] == got[1] != got[2] and got[0].startswith("entity_") and len(got[0]) == 47


@pytest.mark.parametrize("kind,meta,error", [
    ("project", {"status": "active"}, None), ("project", {"status": "ACTIVE"}, None), ("goal", {"status": "nope"}, 'invalid status "nope" for project/goal'),
    ("preference", {"category": "food", "sentiment": "meh"}, 'invalid sentiment "meh" for preference'),
    ("event", {"type": "party"}, 'invalid type "party" for event/milestone'), ("place", {"category": "Home"}, None),
    ("tool", {"type": "rock"}, 'invalid type "rock" for asset/tool'), ("user_identity", {"category": "zodiac"}, 'invalid category "zodiac" for user_identity'),
    ("whatever", {"status": "x"}, None), ("person", {}, None), ("project", {"status": 5}, None),
])
def test_validate_metadata(spark, kind, meta, error):
    df = spark.createDataFrame([(kind, json.dumps(meta))], "k string, m string")
    assert df.select(C.validate_metadata(F.col("k"), F.col("m"))).first()[0] == error


def test_normalise_metadata(spark):
    rows = [
        ("project", '{"project_id": "p1", "status": "Active", "junk": 1, "step_number": 2, "dependencies": ["a"]}',
         {"parent_goal": "p1", "project_id": "p1", "project_uuid": "p1", "status": "active", "step_number": 2, "dependencies": ["a"]}),
        ("person", '{"occupation": "cook", "interests": ["tea", 3, "go"], "birthdate": ""}', {"occupation": "cook", "interests": ["tea", "go"]}),
        ("generic", '{"tags": []}', {"confidence_score": 0.0}),
        ("generic", '{"confidence_score": 1, "tags": ["x"]}', {"confidence_score": 1.0, "tags": ["x"]}),
        ("summary", '{"level": 2.0}', {"level": 2}),
        ("asset", '{"type": "Software", "configuration": {"a": 1}}', {"type": "software", "configuration": {"a": 1}}),
        ("unregistered", '{"z": 1}', {"z": 1}), ("goal", "not json", {}), ("response", '{"logic_trace": "t"}', {"logic_trace": "t"}),
    ]
    df = spark.createDataFrame([(i, k, m) for i, (k, m, _) in enumerate(rows)], "i int, k string, m string")
    got = [r[0] for r in df.orderBy("i").select(C.normalise_metadata(F.col("k"), F.col("m"))).collect()]
    assert [json.loads(g) for g in got] == [w for _, _, w in rows]
    assert all(list(json.loads(g)) == sorted(json.loads(g)) for g in got)


def test_overrides_and_yes(apply):
    cases(apply, C.explicit_override, [
        ("Please remember that I like tea", True), ("Actually, it is Tuesday", True), ("update: x", True), ("I will update: x", False),
        ("hello", False), ("", False), ("  Correct: y", True),
    ])
    cases(apply, C.affirmative, [
        ("yes", True), ("Yes please", True), (" ok ", True), ("yesterday", False), ("no", False), ("go ahead then", True), ("", False), ("yes\nno", False),
    ])


def test_gaps(apply):
    cases(apply, C.gap_in_thought, [
        ("", False), ("no marker", False), ("Identified gaps: none", False), ("identified gaps:\n- N/A", False),
        ("Plan\nIdentified Gaps:\n - birthday of Ann", True), ("identified gaps:   ", False), ("identified gaps:\n*\n- unknown", False),
    ])
    cases(apply, C.gap_in_result, [("No entries found.", True), ("Found 3", False), (None, False)])


def test_missing_info(apply):
    got = apply(C.missing_info, [
        "All good.", "MISSING_INFO: a; b\nThe answer.", "The answer.\nmissing_info: only", "MISSING_INFO: x", "MISSING_INFO:\nrest",
    ])
    assert [(r.answer, r.missing) for r in got] == [
        ("All good.", []), ("The answer.", ["a", "b"]), ("The answer.", ["only"]), ("MISSING_INFO: x", ["x"]), ("MISSING_INFO:\nrest", []),
    ]


def test_strip_done(apply):
    cases(apply, C.strip_done, [
        ("Bought milk done.", "Bought milk"), ("x\n\nDONE", "x"), ("done", ""), (" Done. ", ""), ("undone things", "undone things"), ("  keep  ", "  keep  "), ("", ""),
    ])


def test_cuts(apply):
    assert apply(lambda v: C.cut_bytes(v, 4), ["abc", "abcdef", "aéééé", "日本語", ""]) == ["abc", "abcd", "aé", "日", ""]
    assert apply(lambda v: C.cut_runes(v, 2), ["日本語"]) == ["日本"]
    assert apply(C.valid_utf8, [bytearray(b"ab\xc3"), bytearray("é".encode())], "binary") == ["ab", "é"]


def test_page_text(apply):
    html = "<html><STYLE>x{}</STYLE><script>\nvar a='<b>';</script><p>Fish &amp; chips&nbsp;<b>now</b></p></html>"
    assert apply(C.page_text, [html]) == ["Fish & chips now"]
    assert apply(lambda v: C.page_text(v, 4), [html]) == ["Fish...[truncated]"]


def test_image_tokens(apply):
    assert apply(C.image_token_id, ["see [SEND_IMAGE: e1 ] now", "none", "[SEND_IMAGE: ]"]) == ["e1", None, None]
    assert apply(C.image_caption, ["see [SEND_IMAGE:e1] now [SEND_IMAGE:e2]", "none"]) == ["see  now [SEND_IMAGE:e2]", None]
    assert apply(C.image_tokens_as_sent, ["a [SEND_IMAGE:x] b"]) == ["a [Photo sent] b"]


def test_units(spark):
    rows = [(100.0, "C", "F", 212.0), (1.0, "km", "meters", 1000.0), (1.0, "kg", "lb", 2.205), (1024.0, "MB", "GB", 1.0), (1.0, "kg", "km", None), (1.0, "zz", "m", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v double, a string, b string, w double")
    got = df.orderBy("i").select(C.convert_unit(F.col("v"), F.col("a"), F.col("b")), "w").collect()
    for value, want in got:
        assert (value is None and want is None) or abs(value - want) < 1e-3


def test_codes_zones_prices(apply):
    assert apply(C.weather_label, [0, 3, 47, 50, 99, 100], "int") == ["Clear sky", "Overcast", "Foggy", "Unknown", "Thunderstorm with hail", "Unknown"]
    assert apply(C.zone_of, ["PST", " New York ", "Asia/Dubai"]) == ["America/Los_Angeles", "America/New_York", "asia/dubai"]
    at = lambda a: F.convert_timezone(C.zone_of(F.lit(a)), C.zone_of(F.lit("EST")), F.lit("2024-01-10 15:00:00").cast("timestamp_ntz")).cast("string")
    assert apply(lambda v: at("PST"), ["x"]) == ["2024-01-10 18:00:00"]
    assert apply(C.price_key, ["models/gemini-1.5-pro", "gemini-1.5-flash-8b-001", "", "other", "gemini-1.5"]) == [
        "gemini-1.5-pro", "gemini-1.5-flash-8b", "gemini-2.5-flash", "gemini-2.5-flash", "gemini-1.5-pro"]


def test_text_stats(apply):
    text = "One two three. Four five!\n\nSix seven? Eight nine"
    stats = lambda name: apply(lambda v: C.text_stats(v)[name], [text, "", "no end", "\n\na", "a\n\n \n\nb\n\n"])
    assert stats("n_words") == [9, 0, 2, 1, 2]
    assert stats("n_sentences") == [3, 0, 1, 1, 1]
    assert stats("n_paragraphs") == [2, 0, 1, 1, 2]


KV = [
    ("a: 1\nB: two words", {"a": "1", "b": "two words"}, {}),
    ("Here are your results:\nsummary: ok", {"summary": "ok"}, {}),
    ("items:\none | x\ntwo: not a key with spaces here\nend: 1\nlost", {"end": "1", "two": "not a key with spaces here"}, {"items": ["one | x"]}),
    ("items:\nfirst thing: yes\n\nsecond", {}, {"items": ["first thing: yes", "second"]}),
    ("empty:\nnext:\nx", {}, {"next": ["x"]}),
    ("a: 1\na: 2", {"a": "2"}, {}), ("", {}, {}), ("noise\nmore noise", {}, {}),
    ("s:\na\nt: 1\ns:\nb", {"t": "1"}, {"s": ["a", "b"]}),
]


def test_parse_kv(spark):
    df = spark.createDataFrame([(str(i), t) for i, (t, _, _) in enumerate(KV)], "id string, text string")
    rows = outputs.parse_kv(df).collect()
    for i, (_, simple, sections) in enumerate(KV):
        mine = [r for r in rows if r.id == str(i)]
        assert {r.key: r.value for r in mine if not r.is_section} == simple
        got = {}
        for r in sorted((r for r in mine if r.is_section), key=lambda r: r.pos):
            got.setdefault(r.key, []).append(r.value)
        assert got == sections


def test_subtasks_questions_evaluator(spark):
    text = (
        "is_sequential: TRUE\nsubtasks:\nPlan | make a plan\nBuild | build it | Plan, Review\nbroken\n"
        "questions:\nWho is Ann? | reason: unclear\nWhy?\nsignificance: 1.7\nfuture_commitment: 0.6\ncommitment_intent: call the bank"
    )
    df = spark.createDataFrame([("e", text), ("f", "nothing")], "id string, text string")
    sub = outputs.parse_subtasks(df).orderBy("pos").collect()
    assert [(r.content, r.dependencies, r.is_sequential) for r in sub] == [("Plan: make a plan", [], True), ("Build: build it", ["Plan", "Review"], True)]
    assert [(r.question, r.reason) for r in outputs.parse_questions(df).orderBy("pos").collect()] == [("Who is Ann?", "unclear"), ("Why?", "")]
    ev = {r.id: r for r in outputs.evaluator_fields(df).collect()}
    assert ev["e"].significance == 1.0 and ev["e"].proposal == 'Should I create a task for: "call the bank"?'
    assert ev["f"].domain == "thought" and ev["f"].proposal is None


def test_dates(spark):
    table = [
        ("today", "2024-01-17", "2024-01-17"), ("Yesterday", "2024-01-16", "2024-01-16"), ("last week", "2024-01-08", "2024-01-14"),
        ("last month", "2023-12-01", "2023-12-31"), ("since monday", "2024-01-15", "2024-01-17"), ("since thu", "2024-01-11", "2024-01-17"),
        ("2024-01-02", "2024-01-02", "2024-01-02"), ("2024-01-02T10:00:00Z", "2024-01-02", "2024-01-02"), ("1/5/2024", "2024-01-05", "2024-01-05"),
        ("March 5, 2023", "2023-03-05", "2023-03-05"), ("30 days ago", "2023-12-18", "2023-12-18"), ("since 2024-01-01", "2024-01-01", "2024-01-17"), ("gibberish", None, None),
    ]
    df = spark.createDataFrame([(i, e) for i, (e, _, _) in enumerate(table)], "i int, e string")
    now = F.lit("2024-01-17 09:30:00").cast("timestamp_ntz")  # a Wednesday
    got = df.orderBy("i").select(dates.resolve_range(F.col("e"), F.lit(None).cast("string"), now).alias("r")).collect()
    assert [(r.r.start_date, r.r.end_date) for r in got] == [(s, e) for _, s, e in table]
    r = spark.range(1).select(dates.resolve_range(F.lit("last month"), F.lit("today"), now).alias("r")).first().r
    assert (r.start_date, r.end_date) == ("2023-12-01", "2024-01-17")
    sunday = F.lit("2024-01-21 09:30:00").cast("timestamp_ntz")
    r = spark.range(1).select(dates.relative_range(F.lit("since sunday"), sunday).alias("r")).first().r
    assert str(r.start) == "2024-01-14 00:00:00"


def test_analysis(spark):
    raw = '{"summary": "s", "tags": ["a"], "entities": [{"name": "N", "type": "person", "status": "done"}, {"name": "M", "source_id": "z"}]}'
    df = spark.createDataFrame([("e1", raw), ("e2", "{broken"), ("e3", None)], "id string, raw string")
    got = {r.id: r.a for r in df.select("id", C.parse_analysis(F.col("raw"), F.col("id")).alias("a")).collect()}
    assert [(e.name, e.status, e.source_id) for e in got["e1"].entities] == [("N", "Completed", "e1"), ("M", "In-Progress", "z")]
    assert got["e2"] is None and got["e3"] is None

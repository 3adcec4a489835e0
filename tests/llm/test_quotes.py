from mnemograph.llm import op04

SCHEMA = "conv_id long, turn long, role string, text string, own int, depth string"
ROWS = [
    (1, 0, "user", "Hello there.\nHow  are you?\n\nSecond paragraph\nover two lines."),
    (1, 1, "assistant", "> hello there.\n> How are you?\n\nFine."),
    (1, 2, "user", "On Monday bot wrote:\n> > Hello there.\n> Fine.\nGood to hear."),
    (1, 3, None, "> Second paragraph\n> over two lines.\nYes, that."),
    (1, 4, "user", "> Good to hear.\n>> Fine.\nagain\n> nobody said this"),
    (1, 5, "user", None),
    (1, 6, "user", ""),
    (1, 7, "user", "> Later words"),
    (1, 8, "user", "Later words"),
    (2, 0, "user", "Hello there."),
    (2, 1, "user", "> Hello there.\n> \n> x\nok"),
    (None, 3, "user", "> Hello there.\nz"),
    (3, None, "user", "> Hello there.\nz"),
    (4, 0, "user", "same"),
    (4, 1, "user", "same"),
    (4, 2, "user", "> same\nme too"),
    (4, 3, "user", "> me too\nme three"),
    (4, 4, "user", "> me three\nlast"),
    (4, 5, "user", "> last\nÀ VOUS"),
    (4, 5, "user", "> last\nÀ VOUS"),
    (4, 6, "user", "  >  À vous\nend"),
    (5, 0, "user", "long " * 20_000 + "\n" + "\n".join(f"line {i}" for i in range(2000))),
    (5, 1, "user", "\n".join(f"> line {i}" for i in range(2000)) + "\nagreed"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "d") for r in rows], SCHEMA)


def test_links_follow_quotes(spark):
    from mnemograph.llm.quotes import by_reply

    got = {(r.conv_id, r.turn): r for r in by_reply(table(spark, ROWS)).collect()}
    links = {k: (r.reply_to, r.thread, r.depth) for k, r in got.items()}
    assert links[1, 1] == (0, 0, 1) and links[1, 2] == (1, 0, 2) and links[1, 3] == (0, 0, 1) and links[1, 4] == (2, 0, 3)
    assert links[1, 7] == (None, 7, 0) and links[2, 1] == (0, 0, 1) and links[4, 6] == (5, 0, 5) and links[5, 1] == (0, 0, 1)
    assert got[1, 2].own == "Good to hear." and got[1, 2].formatted == "<|user|>\nGood to hear.\n<|end|>" and got[1, 3].formatted.startswith("<|unknown|>")
    assert got[1, 5].own == "" and got[1, 4].n_quoted == 3 and got[1, 4].own == "again"
    order = sorted((r for r in got.values() if r.conv_id == 4), key=lambda r: (r.thread, r.depth, r.turn))
    assert [r.turn for r in order] == [0, 2, 3, 4, 5, 6, 1]


def test_twin_agrees(spark, tmp_path, twin, same):
    messages = table(spark, ROWS)
    messages.write.parquet(f"{tmp_path}/conversations.parquet")
    same(op04.query(spark, str(tmp_path)), twin(op04.SQL, conversations=messages))


def test_no_rows(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op04.query(spark, str(tmp_path)).count() == 0

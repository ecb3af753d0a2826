import random

from pyspark.sql import functions as F

from sightline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    talks = {c: tuple(t[1:] for t in sorted(ts)) for c, ts in talks.items()}
    kept = {}
    for c, said in talks.items():
        if not any(other[: len(said)] == said and len(other) > len(said) for other in talks.values()):
            if said not in kept or c < kept[said]:
                kept[said] = c
    return {c: "".join(f"<|{r}|>\n{t}\n" for r, t in said) for said, c in kept.items()}


def got(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("mine") for n in ("place", "h1", "n_turns", "turns")})
    return {r["conv_id"]: r["rendered"] for r in chat.render(chat.maximal_conversations(frame)).collect()}


def test_snapshots_by_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for conv in range(150):
        base = draw.randint(0, 12)
        talk = [("user" if t % 2 == 0 else "assistant", f"{base}-{t if draw.random() < 0.97 else 'x'}") for t in range(draw.randint(1, 9))]
        rows += [(conv, t * draw.choice([1, 1]), r, x) for t, (r, x) in enumerate(talk)]
    assert got(spark, rows) == expected(rows)


def test_awkward_turns(spark):
    rows = [
        (1, None, "user", "a"), (1, 5, None, None), (2, 1, "user", "a"), (3, 1, "user", "a"), (3, 1, "user", "a"), (4, 0, "", ""), (5, 0, None, ""), (6, 1, "userx", ""), (7, 1, "user", "x"), (8, 0, "user", "long " * 50_000),
    ]
    assert got(spark, rows) == expected(rows)
    assert got(spark, []) == {}


def test_no_conversation_is_lost_among_equal_ones(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(40) for t in range(1 + c % 4)]
    assert list(got(spark, rows)) == [3]


def test_null_conversation_id(spark):
    frame = spark.createDataFrame([(None, 1, "user", "a"), (1, 1, "user", "b")], SCHEMA)
    assert chat.render(chat.maximal_conversations(frame)).count() == 2


def test_turns_without_a_conversation_stand_alone(spark):
    rows = [
        (None, 1, "user", "a"), (None, 2, "user", "a"), (1, 1, "user", "a"), (None, 1, "user", "b"), (2, 1, "user", "b"), (2, 2, "bot", "y"), (None, 3, "user", "c"), (None, None, None, None), (None, 4, "user", "c"),
    ]
    kept = chat.render(chat.maximal_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r["conv_id"] or 0, r["n_turns"], r["rendered"]) for r in kept) == [
        (0, 1, "<|user|>\nc\n"), (0, 1, "<||>\n\n"), (1, 1, "<|user|>\na\n"), (2, 2, "<|user|>\nb\n<|bot|>\ny\n"),
    ]
    import duckdb

    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(map(str, db.execute(chat.ORACLE).fetchall())) == sorted(str((r["conv_id"], r["n_turns"], r["rendered"])) for r in kept)

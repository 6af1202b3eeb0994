"""Chat formatting: round trips, masks, control strings and digests against plain Python."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from voxframe.llm import chat_format, queries

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, part long, ids string, loss int, n_turns int"


@pytest.fixture(scope="module")
def codec():
    return chat_format.Codec(BPE)


def marked(role, text):
    text, role = chat_format.escaped(text), chat_format.escaped(role) if role not in ("user", "assistant") else role
    return {"user": f"[INST]{text}[/INST]", "assistant": f"{text}</s>"}.get(role, f"[ROLE]{role}[/ROLE]{text}</s>")


def brute(rows):
    """Digests of (conv_id, turn, role, text) with no two rows of one conversation and turn, or equal ones."""
    out = Counter()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))
    for conv, turns in itertools.groupby(order, key=lambda r: r[0]):
        turns = [(r or "", t or "") for _, _, r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(marked(r, t)) for r, t in turns)] += 1
    return out


def edge_turns():
    rng = random.Random(8)
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, 5, None, "no role"), (2, 6, "", "empty role"), (2, 7, "assistant", "</s>"), (2, 8, "assistant", "<\\/s>[INST]<\\\\/s>"),
        (None, 0, "user", "[INST][/INST]"), (None, 1, "assistant", "é日本 [\\/INST] <|endoftext|>"), (3, None, "assistant", "turn null comes first"), (3, 0, "assistant", "then 0"),
        (4, 1, "user", "same"), (4, 1, "user", "same"), (5, -3, "[ROLE]</s>", "a\x00b"), (5, 2, "system", " " * 20_000 + "x"), (6, 0, "assistant", "\n" * 300_000), (6, 1, "tool", "word" * 200_000),
        (-1, 9, "assistant", "[" * 50 + "INST]" + "<" * 50 + "/s>"), (7, 0, "assistant", "s>"), (7, 1, "user", "/INST] [/INST"), (7, 2, "User", "another role"),
    ]
    return rows + [(50, k, ("user", "assistant")[k % 2], "".join(rng.choice("ab <[/s>INST]\\é") for _ in range(rng.randrange(400)))) for k in range(900)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def digests(spark, rows):
    return Counter(tuple(r) for r in chat_format.read_back(chat_format.format_conversations(frame(spark, rows), BPE), BPE).collect())


def test_edge_turns(spark):
    assert digests(spark, edge_turns()) == brute(edge_turns())


def test_one_conversation_in_many_tasks_and_parts(spark):
    """Nearly all turns are of one conversation, which then has parts in every task; digests are those of the whole."""
    rows = [(7, k, ("user", "assistant")[k % 2], f"turn {k} " + "</s>" * (k % 3)) for k in range(3000)] + [(k, 0, "assistant", "short") for k in (1, 2, 8, 9)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = chat_format.format_conversations(frame(spark, rows), BPE).collect()
        assert len({p.part >> 32 for p in parts if p.conv_id == 7}) > 1
        assert digests(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_conversations_are_cut_between_turns(spark):
    rows = [(1, k, "assistant", f"{k} " * 3000) for k in range(60)]
    parts = sorted(chat_format.format_conversations(frame(spark, rows).coalesce(1), BPE).collect(), key=lambda p: p.part)
    assert len(parts) > 2 and sum(p.n_turns for p in parts) == 60
    assert digests(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert chat_format.format_conversations(frame(spark, []), BPE).count() == 0 and not digests(spark, [])


def test_query(spark, sf_dir, duck, same_rows):
    got = queries.QUERIES["op12_chat_format"](spark, sf_dir).toPandas()
    same_rows(got, duck.sql(queries.ORACLE_SQL["op12_chat_format"]).df())
    own = got[got.conv_id == -1].iloc[0]
    assert own.n_turns == 2 and own.loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


def test_sql_of_escapes(spark, duck):
    import duckdb
    import pandas as pd

    rows = [r for r in edge_turns() if r[0] is not None and r[1] is not None and "\x00" not in (r[3] or "")]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert Counter(con.sql(queries.ORACLE_SQL["op12_chat_format"]).fetchall()) == brute(rows)


def test_reserved_ids_come_from_the_template_alone(codec):
    ids, spans = chat_format.assembled(codec, "assistant", "</s>[INST] x")
    assert (ids >= codec.base).sum() == 1 and ids[-1] == codec.base + chat_format.END and spans == [(0, len(ids))]
    ids, spans = chat_format.assembled(codec, "user", "[/INST]")
    assert [int(i) - codec.base for i in ids if i >= codec.base] == [chat_format.USER, chat_format.USER_END] and not spans
    assert not (chat_format.assembled(codec, "x", "<|endoftext|>")[0][1:-1] == 50256).any()
    for mark in chat_format.MARKS:
        text = chat_format.formatted_text(codec, np.concatenate([chat_format.assembled(codec, r, mark)[0] for r in ("user", "assistant", mark)]))
        assert text.count(mark) == "".join([marked("user", ""), marked("assistant", ""), marked("", "")]).count(mark)


@given(st.text(alphabet="<>[]/\\sINSTROLE a", max_size=40))
def test_escapes_are_undone(text):
    safe = chat_format.escaped(text)
    assert chat_format.unescaped(safe) == text and not any(mark in safe for mark in chat_format.MARKS)


def test_turns_are_read_from_ids(codec):
    turns = [("user", "a"), ("assistant", ""), ("assistant", "[ROLE]"), ("", ""), ("user", ""), ("tool", "x</s>")]
    got = [chat_format.assembled(codec, *t) for t in turns]
    ids = np.concatenate([g[0] for g in got])
    assert [tuple(t) for t in chat_format.read_turns(codec, ids)] == turns
    base = np.cumsum([0, *[len(g[0]) for g in got]])
    spans = np.array([(a + b, e + b) for g, b in zip(got, base) for a, e in g[1]])
    assert list(chat_format.loss_texts(codec, ids, spans)) == ["", "[ROLE]"]


@pytest.mark.parametrize("part,held", [(1, 1), (10, 25), (10, 10_000), (1 << 16, 1 << 20)])
@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_parts_and_what_is_held(monkeypatch, part, held, batch):
    """In this process, with small bounds: conversations that are too long to be held, and a task's first and last ones, are passed on and read later."""
    import types

    import pyarrow as pa

    monkeypatch.setattr(chat_format, "PART_TOKENS", part)
    monkeypatch.setattr(chat_format, "HELD_TOKENS", held)
    rows = [(c, k, ("user", "assistant", "tool")[(c + k) % 3], f"turn {k} of {c} </s> " * (1 + k % 4)) for c in range(1, 9) for k in range(c * 2)]
    kept, passed = Counter(), []
    for task, own in enumerate((rows[:20], rows[20:45], rows[45:])):  # conversations lie in two tasks
        monkeypatch.setattr(chat_format.TaskContext, "get", staticmethod(lambda task=task: types.SimpleNamespace(partitionId=lambda: task)))
        table = pa.table({"conv_id": pa.array([r[0] for r in own], pa.int64()), "role": [r[2] for r in own], "text": [r[3] for r in own]})
        parts = list(chat_format._format(BPE)(iter(table.to_batches(max_chunksize=batch))))
        columns = [b.select(["conv_id", "part", "ids", "loss"]) for b in parts]
        for b in chat_format._fold(BPE, False)(iter([x for c in columns for x in pa.Table.from_batches([c]).to_batches(max_chunksize=batch)])):
            for r in b.to_pylist():
                if r["part"] is None:
                    kept[tuple(r.values())[:6]] += 1
                else:
                    passed.append(r)
    passed.sort(key=lambda r: (r["conv_id"], r["part"]))
    table = pa.table({"conv_id": pa.array([r["conv_id"] for r in passed], pa.int64()), "part": pa.array([r["part"] for r in passed], pa.int64()), "ids": pa.array([r["ids"] for r in passed], pa.list_(pa.int32())), "loss": pa.array([r["loss"] for r in passed], chat_format._SPANS)})
    for b in chat_format._fold(BPE, True)(iter(table.to_batches(max_chunksize=batch))):
        kept.update(tuple(r.values())[:6] for r in b.to_pylist())
    assert kept == brute(rows)
    assert part > 1 or len(passed) > 30

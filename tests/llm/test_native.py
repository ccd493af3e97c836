"""Chat formatting and line dedup against plain Python."""

import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.llm import chat, line_dedup

CHAT = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"
HOSTILE = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "\\", "\\\\<\\|", "[\\INST]", "<s", "", None, "a\nb", "<|", "<<||"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected_chat(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def read(spark, rows):
    found = chat.read_back(chat.segments(spark.createDataFrame(rows, CHAT)))
    return {r["conv_id"]: tuple(r)[1:5] for r in found.collect()}


def test_hostile_texts_come_back(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", HOSTILE[(c + t) % len(HOSTILE)]) for c in range(len(HOSTILE)) for t in range(6)]
    assert read(spark, rows) == expected_chat(rows)


def test_chat_edges(spark):
    rows = [
        (1, 0, "user", "x"), (None, 0, "assistant", "null conversation"), (2, None, "user", "null turn"), (2, 0, None, "null role"), (3, 0, "assistant", "same"),
        (3, 0, "assistant", "same"), (4, 5, "assistant", "é" * 50_000), (5, 0, "<|text|>", "odd role"), (6, 1, "user", None), (6, 0, "assistant", None),
    ]
    assert read(spark, rows) == expected_chat(rows)
    assert read(spark, []) == {}
    extra = spark.createDataFrame([(1, 0, "assistant", "x", 9, "y")], CHAT + ", seq long, segment string")
    assert chat.read_back(chat.segments(extra)).count() == 1


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<|s>/[INST]\\ab\n", max_size=30))
def test_escape_in_python_terms(text):
    """The same scheme by re, so that hypothesis can try many texts."""
    import re

    tail = r"(?=\||s>|/s>|INST\]|/INST\])"
    made = re.sub(r"(<|\[)" + tail, r"\1\\", text.replace("\\", "\\\\"))
    for control in ("<|", "<s>", "</s>", "[INST]", "[/INST]"):
        assert control not in made
    assert re.sub(r"(<|\[)\\" + tail, r"\1", made).replace("\\\\", "\\") == text


def test_contexts_are_prefixes(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text <s> {i}") for i in range(6)] + [(2, 0, "user", "no reply")]
    turns = chat.segments(spark.createDataFrame(rows, CHAT))
    formatted = chat.streams(turns)
    whole = formatted.filter("conv_id = 1").first()["formatted"]
    made = chat.expand(formatted).orderBy("conv_id", "example").collect()
    spans = chat.examples(turns).orderBy("example").collect()
    assert [(r["conv_id"], r["example"]) for r in made] == [(1, 0), (1, 1), (1, 2), (2, None)]
    for r, span in zip(made, spans, strict=False):
        assert whole.startswith(r["context"] + r["target"]) and r["target"] == span["target"]
        assert len(r["context"]) == span["context_chars"] and r["n_context_turns"] == span["n_context_turns"] == 2 * r["example"] + 1
        assert whole[r["loss_start"] : r["loss_stop"]] == f"text <\\s> {2 * r['example'] + 1}"
        assert (r["loss_start"], r["loss_stop"]) == (span["loss_start"], span["loss_stop"])
    read = {r["conv_id"]: r for r in chat.read_back(turns).collect()}
    digests = "".join(sha(r["context"] + r["target"]) for r in made[:3])
    assert read[1]["examples_sha256"] == sha(digests) and read[1]["expanded_chars"] == sum(len(r["context"] + r["target"]) for r in made[:3])
    assert (read[2]["n_examples"], read[2]["expanded_chars"], read[2]["examples_sha256"]) == (0, 0, sha(""))


def expected_lines(rows, min_chars=20, min_docs=3):
    blanks = " \t\n\x0b\x0c\r"
    lower = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda line: line.strip(blanks).translate(lower)
    rank = lambda d: -(1 << 63) if d is None else d
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(rank(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [len(k := key(x)) >= min_chars and len(holders[k]) >= min_docs and max(holders[k]) != rank(doc) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((doc, len(lines), sum(gone), kept))
    return sorted(out, key=repr)


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    pool = [f"A repeated line number {i} of Élan" for i in range(30)] + ["short", "", "x" * 19, "y" * 20]
    rows = []
    for doc in range(200):
        lines = [rng.choice(["", "  ", "\t"]) + (s.upper() if rng.random() < 0.3 else s) + rng.choice(["", "\r", " "]) for s in rng.choices(pool, k=rng.randint(0, 6))]
        rows.append((doc * 7, "\n".join(lines)))
    rows += [(None, pool[0]), (5, None), (3, f"{pool[1]}\n{pool[1]}\nowner?"), (7, rows[1][1]), (7, "another text\n" + pool[2])]
    for batches, fanout in ((1, 3), (6, 2)):
        got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, DOCS), batches=batches, fanout=fanout)
        assert sorted(map(tuple, got.collect()), key=repr) == expected_lines(rows)


def test_lines_edges(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "w" * 100_000 + f"\n{'z' * 30}") for i in range(4)]
    extra = spark.createDataFrame([(*r, 1, "k") for r in rows], DOCS + ", pos int, gone string")
    assert sorted(map(tuple, line_dedup.drop_repeated_lines(extra).collect()), key=repr) == expected_lines(rows)


def test_native_plans_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], DOCS)
    plan = line_dedup.drop_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    turns = chat.segments(spark.createDataFrame([(1, 0, "user", "x")], CHAT))
    plan += chat.read_back(turns)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_runs_are_compacted(spark):
    index = line_dedup.LineRuns(spark, fanout=2)
    for doc in range(5, 0, -1):
        index.add(spark.createDataFrame([(doc, doc, 0), (doc, 100, 0)], "doc long, h1 long, h2 long"))
    assert all(len(level) < 2 for level in index.levels) and len(index.levels) >= 3
    got = {r["h1"]: (r["owner"], r["n_docs"]) for r in index.keys().collect()}
    assert got == {100: (5, 5), **{d: (d, 1) for d in range(1, 6)}}
    assert sum(run.filter(F.col("h1") == 100).count() for run in index.runs()) == 1


def test_runs_are_merged_as_they_lie(spark):
    rng = random.Random(5)
    index = line_dedup.LineRuns(spark, fanout=4, buckets=4)
    plans = []
    for doc in range(4, 0, -1):
        batch = spark.createDataFrame([(doc, rng.randrange(200), 0) for _ in range(100)], "doc long, h1 long, h2 long")
        plans.append(index.merged(batch))
        index.add(batch)
    for n, plan in enumerate(plans):
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert text.count("SortMergeJoin") == n and text.count("Exchange") == 3, text
    index.close()

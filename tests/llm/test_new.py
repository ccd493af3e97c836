"""Byte-pair rounds, conversation repair and fill-in-middle against the library, brute force and plain Python."""

import hashlib
import heapq
import os
import random
import re
import subprocess
import sys
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.llm import bpe, infill, repair
from siftwell.llm.queries import op11_bpe_rounds, tokenizer_path

DOCS = "doc_id long, text string"
EXTRA = DOCS + ", ids string, n_tokens string, form string, output string, h1 string, n int"
CHAT = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# byte pairs


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(tokenizer_path(), most=300)


def same(encoder, library, texts):
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, text[:100]
            assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_ids_equal_the_library(encoder, library):
    rng = random.Random(5)
    texts = [
        "", " ", "\n\t", "don't we'll x's A²b ½", "İstanbul ΣΑΣ é é 日本語 हिन्दी", "a<|endoftext|> b <|startoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext", "odd \x1c blank \x85 \xa0 x",
        "ŉ ſ ǅ ﬁ ª º µ ×÷", "x" * 5000, "aaaaaaa aaaa " * 5, "😀👍🏽 ​‍", "100% 3.14 -- !!! 'tis ''s",
    ]
    texts += ["".join(rng.choice("aAéÉß .,'’\"0²<|>\n\tſĿ\x1fΣ日") for _ in range(200)) for _ in range(200)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    same(encoder, library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_ids_of_any_text_equal_the_library(encoder, library, texts):
    same(encoder, library, texts)


@pytest.mark.parametrize("letters", ["x", "ab", "abcdefghijklmnopqrstuvwxyz", "etaoinshr", "éü"])
def test_long_words_equal_the_library(encoder, library, letters):
    rng = random.Random(7)
    same(encoder, library, ["".join(rng.choice(letters) for _ in range(n)) for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 20_000)])


def test_long_texts_are_cut_at_blanks(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    rng = random.Random(8)
    for alphabet in ("ab é\n,'", "ab<|endoftext|> ", "日本 ́é "):
        text = "".join(rng.choice(alphabet) for _ in range(2000))
        assert np.frombuffer(encoder.encode_long(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_table_that_rounds_would_get_wrong_is_refused():
    letters = bpe.byte_letters()
    vocabulary = {x: i for i, x in enumerate([*letters, *(x + "#" for x in letters), "ab", "abc", "bc"])}
    bpe.MergeTable(vocabulary, [("a", "b"), ("ab", "c")], "#")
    for wrong in ([("ab", "c"), ("a", "b")], [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")]):
        with pytest.raises(ValueError):
            bpe.MergeTable(vocabulary, wrong, "#")


def test_encoding_of_tables(spark, library):
    rows = [(1, None), (1, None), (2, ""), (None, "null id"), (3, "word " * 300_000), (4, "y" * 100_000), (4, "Sélection naïve"), (4, "Sélection naïve")]
    given_rows = spark.createDataFrame([(*r, "a", "b", "c", "d", "e", 1) for r in rows], EXTRA)
    got = bpe.decode(bpe.encode(given_rows, tokenizer_path()), tokenizer_path()).collect()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, map(lambda r: (r[0], r[1], bytes(r[2]), r[3]), got))) == sorted(map(repr, want))
    assert bpe.decode(bpe.encode(spark.createDataFrame([], DOCS), tokenizer_path()), tokenizer_path()).count() == 0


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in op11_bpe_rounds(spark, sf).collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.add((r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == want


# repair


def brute_repair(initials, found):
    """Cheapest cost and least audit by search over all edits: states are (turns done, roles so far as the pattern's place)."""
    moves = {("^", "s"): "s", ("^", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, done = [(0, "", 0, "^")], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(initials) and q in "^a":
            return cost, audit
        for x in "ua":
            if (q, x) in moves:
                heapq.heappush(heap, (cost + 5, audit + "I", i, moves[q, x]))
        if i < len(initials):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q))
            if found[i] not in ("blank", "duplicate"):
                own = 5 if found[i] else 0
                for x in "ua":
                    if (q, x) in moves and x != initials[i]:
                        heapq.heappush(heap, (cost + own + 1, audit + "R", i + 1, moves[q, x]))
                if (q, initials[i]) in moves:
                    heapq.heappush(heap, (cost + own, audit + "K", i + 1, moves[q, initials[i]]))
    raise AssertionError


def check_plan(initials, found):
    cost, edits = repair.plan(list(initials), list(found))
    assert (cost, "".join(e for e, _, _ in edits)) == brute_repair(initials, found)
    assert re.fullmatch("(s?(ua)+)?", "".join(x for e, _, x in edits if e != "D"))
    assert [i for e, i, _ in edits if e != "I"] == list(range(len(initials)))


@pytest.mark.parametrize("n", range(6))
def test_every_short_conversation(n):
    for initials in product("suat", repeat=n):
        check_plan(initials, [""] * n)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from(["", "", "", "blank", "duplicate", "truncated"])), max_size=14))
def test_edits_against_all_edits(turns):
    check_plan([r for r, _ in turns], [f for _, f in turns])


def test_a_long_conversation_takes_linear_time():
    rng = random.Random(1)
    n = 200_000
    cost, edits = repair.plan([rng.choice("sua") for _ in range(n)], [rng.choice(["", "", "truncated", "blank"]) for _ in range(n)])
    assert cost > 0 and len(edits) >= n


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        blank = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows, convs):
    out = {}
    for conv in convs:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        found, seen = [], set()
        for _, role, text in own:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            found.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = brute_repair([r[:1] for _, r, _ in own], found)
        left, i, m = [], 0, sum(e != "D" for e in audit)
        for e in audit:
            role = None if e == "D" else ("system" if m % 2 and not left else "user" if (len(left) - m % 2) % 2 == 0 else "assistant")
            if e == "I":
                left.append(f"{role}:")
                continue
            if e != "D":
                left.append(f"{own[i][1] if e == 'K' else role}:{own[i][2]}")
            i += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, "\n".join(left))
    return out


def test_repair_of_tables(spark):
    rng = random.Random(3)
    texts = ["Fine.", "Fine.", "cut", "", " \t", None, "Why?", "x" * 100_000 + "!", "é。"]
    rows = [(c if c < 60 else None, rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(61) for _ in range(rng.randint(1, 8))]
    rows += rows[:20]
    given_rows = spark.createDataFrame([(*r, "p", "q", 1) for r in rows], CHAT + ", present string, copy string, audit int")
    got = repair.repair(repair.damaged(given_rows), F.col("present")).collect()
    result = {r["conv_id"]: (*tuple(r)[1:8], "\n".join(f"{t['role']}:{t['text']}" for t in r["repaired"])) for r in got}
    assert result == plain_repair(plain_damage(rows), {r[0] for r in rows}) and len(got) == len(result)
    assert repair.repair(spark.createDataFrame([], CHAT)).count() == 0
    whole = repair.repair(spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], CHAT)).collect()
    assert whole[0]["audit"] == "KK" and whole[0]["cost"] == 0


def test_a_conversation_spans_batches(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(25_000)]
    [r] = repair.repair(spark.createDataFrame(rows, CHAT)).collect()
    assert r["cost"] == 4 and r["audit"] == "D" + "K" * 24_998 + "D"


# fill in the middle


def plain_infill(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_infill_of_tables(spark):
    rng = random.Random(4)
    rows = [(None, "null id here"), (1, None), (1, ""), (2, "a <P> b"), (3, "x<M>"), (4, "<S"), (5, "é" * 40_000 + "ab" * 30_000), (6, "a" * 300_000), (7, "!" * 20_000)]
    rows += [(i, "".join(rng.choice("aZé日 <>PSM\n😀") for _ in range(rng.randint(0, 300)))) for i in range(10, 400)]
    rows += rows[-5:]
    given_rows = spark.createDataFrame([(*r, "a", "b", "c", "d", "e", 1) for r in rows], EXTRA)
    made = infill.transform(given_rows).withColumn("restored", infill.restore(F.col("output"), F.col("form")))
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, (plain_infill(*r) for r in rows)))
    assert {r[2] for r in made.select("doc_id", "n", "form").collect()} == {"plain", "psm", "spm"}
    assert infill.transform(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abZ é日😀.", max_size=60), min_size=1, max_size=6), st.integers(1, 9), st.integers(1, 30))
def test_chunks_of_any_size_cut_alike(texts, size, slab):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    stops = np.cumsum([len(r) for r in raw])
    chunks = infill.Chunks(data, np.append(0, stops[:-1]), stops, size, slab)
    for i, text in enumerate(texts):
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert chunks.tokens[i] == len(tokens)
        for k in range(len(tokens) + 1):
            place, chars = chunks.cut(i, k)
            before = "".join(tokens[:k])
            assert chars == len(before) and place == stops[i] - len(raw[i]) + len(before.encode())


# executors


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Every operator's query runs where only the driver can import the library."""
    code = """
import sys
sys.path.append({repo!r})
from pyspark.sql import SparkSession
conf = {{"spark.master": "local-cluster[1,4,3000]", "spark.executor.memory": "2500m", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://{tmp}/shared", "spark.sql.warehouse.dir": "{tmp}/warehouse"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
try:
    spark.range(1).mapInPandas(lambda x: [__import__("siftwell")] and x, "id long").collect()
    raise SystemExit("the workers can import the package")
except Exception as e:
    assert "No module named 'siftwell'" in str(e), e
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name[:2] == "op" and name[2].isdigit():
        assert query(spark, "/root/testdata/sf0.001").count() > 0
        print("ran", name, flush=True)
"""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")} | {"PYSPARK_PYTHON": sys.executable, "PYTHONSAFEPATH": "1", "SPARK_SCALA_VERSION": "2.13"}
    env["PYSPARK_SUBMIT_ARGS"] = "--driver-memory 2g pyspark-shell"
    found = subprocess.run([sys.executable, "-c", code.format(repo=repo, tmp=tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert found.stdout.count("ran op") == 13, found.stdout[-500:] + found.stderr[-3000:]


# paragraphs: no partner of a frequent band code is left out


@pytest.mark.parametrize("unlike", [10, 200])
def test_of_many_members_under_one_code_all_meet_that_are_similar(unlike):
    from siftwell.llm.paragraphs import Paragraphs

    rng = random.Random(unlike)
    seed = [f"s{i}" for i in range(10)]
    text = lambda left, right: " ".join([*left, *seed, *right])
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    pairs = []
    members = [(i, text(fresh(41), fresh(41)), 41, [7]) for i in range(unlike)]
    for p in range(5):  # 51 words with one that differs
        left, right = fresh(41), fresh(41)
        for q in range(3):
            edited = [*left]
            edited[20] = f"e{p}{q}"
            members.append((1000 + 10 * p + q, text(edited, right), 41, [7, 100 + 10 * p + q]))
        pairs.append({1000 + 10 * p + q for q in range(3)})
    rng.shuffle(members)
    groups = {}
    for a, b, *_ in Paragraphs(10, 51, 0.8, 5).links(members):
        joined = groups.get(a, {a}) | groups.get(b, {b})
        groups |= {x: joined for x in joined}
    assert {frozenset(g) for g in groups.values()} == {frozenset(p) for p in pairs}


def test_thousands_of_edited_copies_under_one_code_take_few_comparisons():
    from siftwell.llm.paragraphs import Paragraphs

    rng = random.Random(3)
    words = [f"w{i}" for i in range(92)]
    members = []
    for i in range(3000):
        own = list(words)
        own[rng.choice([*range(0, 40), *range(52, 92)])] = f"e{i}"
        members.append((i, " ".join(own), 41, [1, 2, 3]))
    compare = Paragraphs(10, 51, 0.8, 5)
    calls = []
    plain = compare.pair
    compare.pair = lambda *a: calls.append(1) or plain(*a)
    assert len(list(compare.links(members))) == 2999 and len(calls) < 4000

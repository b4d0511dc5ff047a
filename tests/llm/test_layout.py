"""Sharding, conversation repair and fill-in-the-middle against brute force, and their defined results for odd inputs."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fathom.llm import conversations, fim, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def size(text):
    return len((text or "").encode()) + 16


# sharding


def sharded_rows(df, n=sharding.SHARDS):
    """Checks that hold for every result: gapless slots, shards in range; returns rows in the order of shard and slot."""
    rows = sorted(df.collect(), key=lambda r: (r.shard, r.slot))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(n))
    return rows


def midpoint_shards(sizes, n):
    total, before, out = sum(sizes), 0, []
    for x in sizes:
        out.append(min(n - 1, (2 * before + x) * n // (2 * total)))
        before += x
    return out


@pytest.fixture(scope="module")
def copies(spark):
    """A third of all rows are copies of one text; some rows repeat wholly; ids and texts are null here and there."""
    rng = random.Random(4)
    rows = [(i, "hot " * 20, "en", "a", 80) for i in range(700)]
    rows += [(i, "".join(rng.choice("abc é") for _ in range(rng.randrange(0, 400))), "en", "b", 0) for i in range(700, 1900)]
    rows += [(5000, "same row", None, None, None)] * 300 + [(None, "no id", "en", "a", 5)] * 40 + [(6000 + i, None, "en", "a", None) for i in range(30)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(7)


@pytest.mark.parametrize("cells", [sharding.CELLS, 64])
def test_shards_are_the_midpoint_rule_in_key_order(spark, copies, monkeypatch, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    monkeypatch.setattr(sharding, "CELL_ROWS", 8)
    monkeypatch.setattr(sharding, "CELL_BYTES", 2000)
    rows = sharded_rows(sharding.sharded(copies))
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in copies.collect())
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()[:8]
    keys = [(md5(r.text or ""), "0" * 8 if r.doc_id is None else md5(str(r.doc_id))) for r in rows]
    assert keys == sorted(keys)
    assert [r.shard for r in rows] == midpoint_shards([size(r.text) for r in rows], 40)
    # each splitter is within half a row of its place
    shards = Counter()
    for r in rows:
        shards[r.shard] += size(r.text)
    fair, most = sum(shards.values()) / 40, max(size(r.text) for r in rows)
    assert len(shards) == 40 and max(abs(b - fair) for b in shards.values()) <= most


def test_tolerance_keeps_groups_whole(spark):
    texts = [f"text number {i}" for i in range(50)]
    docs = spark.createDataFrame([(i, texts[i % 50], "en", "a", 0) for i in range(2000)], DOCS)
    rows = sharded_rows(sharding.sharded(docs, shards=5, tolerance=0.2), 5)
    held = defaultdict(set)
    for r in rows:
        held[r.text].add(r.shard)
    assert all(len(s) == 1 for s in held.values())
    b = Counter()
    for r in rows:
        b[r.shard] += size(r.text)
    fair = sum(b.values()) / 5
    assert all(abs(x - fair) <= 0.4 * fair for x in b.values())


def test_sharding_odd_inputs(spark):
    assert sharding.sharded(spark.createDataFrame([], DOCS)).count() == 0
    one = sharded_rows(sharding.sharded(spark.createDataFrame([(1, None, None, None, None)], DOCS)))
    assert [(r.shard, r.slot) for r in one] == [(20, 0)]
    long = spark.createDataFrame([(i, "x" * (2_000_000 if i == 3 else 10), "en", "a", 0) for i in range(60)], DOCS)
    rows = sharded_rows(sharding.sharded(long))
    assert [r.shard for r in rows] == midpoint_shards([size(r.text) for r in rows], 40)
    clash = spark.createDataFrame([(i, f"t{i}", i) for i in range(100)], "doc_id long, text string, n long")
    clash = clash.select("*", *[F.col("n").alias(c) for c in ("shard", "slot", "row", "key", "bytes", "cell", "p0", "c0")])
    out = sharding.sharded(clash, shards=4)
    assert out.columns == [*clash.columns, "_shard", "_slot"]
    assert all(r.shard == r.n == r.row for r in out.collect())
    with pytest.raises(ValueError):
        sharding.sharded(clash, shards=0)


def test_op11_columns(spark, copies, tmp_path):
    copies.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sharded_rows(sharding.op11(spark, str(tmp_path)))
    text = {r.doc_id: r.text for r in copies.collect()}
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size(text[r.doc_id]), zlib.crc32((text[r.doc_id] or "").encode()), "bytes", None)


# conversations

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if c == 0:
            continue
        if c == 1:
            text = ""
        if c == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        if c == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if c == 3 else 1)
    for own in out.values():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    return out


def cheapest(turns, gone, cut):
    """The least (cost, audit) over all edits that lead to the form, by shortest path, and the repaired turns."""
    step = lambda state, x: {("start", "s"): "s", ("start", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, x))
    queue, seen = [(0, "", 0, "start", ())], set()
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if i == len(turns) and state in ("start", "a"):
            return cost, audit, out
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for role in ("user", "assistant"):
            if to := step(state, role[0]):
                heapq.heappush(queue, (cost + 5, audit + "I", i, to, (*out, f"{role}:")))
        if i == len(turns):
            continue
        heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, out))
        if gone[i]:
            continue
        _, role, text = turns[i]
        if role and (to := step(state, role[0])):
            heapq.heappush(queue, (cost + 5 * cut[i], audit + "K", i + 1, to, (*out, f"{role}:{text}")))
        for new in ("user", "assistant"):
            if to := step(state, new[0]):
                heapq.heappush(queue, (cost + 1 + 5 * cut[i], audit + "R", i + 1, to, (*out, f"{new}:{text}")))


def expected(rows, changed=None):
    found = damage(rows) if changed is None else changed
    out = {}
    for conv in {r[0] for r in rows}:
        turns, faults, seen = found.get(conv, []), [], set()
        for _, role, text in turns:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        initials = [role[:1] for _, role, _ in turns]
        cost, audit, lines = cheapest(turns, [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ünder"])
            text = rng.choice(["Yes.", "No", "Why?", "", " \t", None, "é!\n", "a: b ", "Yes.", f"{turn} ok!"])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 3]), role, text))
    rows += [rows[10], rows[10], rows[40]]
    rng.shuffle(rows)
    return rows


def test_repair_is_the_cheapest(spark, talks):
    df = conversations.digests(conversations.damaged(spark.createDataFrame(talks, TURNS).repartition(5)))
    got = {r.conv_id: tuple(r) for r in df.collect()}
    assert got == expected(talks)
    assert len({r[7] for r in got.values()}) > 40


def test_repaired_turns_are_those_of_the_digest(spark, talks):
    turns = spark.createDataFrame(talks, TURNS)
    plain = defaultdict(list)
    for conv, turn, role, text in talks:
        plain[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for own in plain.values():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    want = expected(talks, plain)
    assert {r.conv_id: tuple(r) for r in conversations.digests(turns).collect()} == want
    edits = defaultdict(list)
    for r in conversations.repaired(turns).orderBy("place").collect():
        edits[r.conv_id].append(r)
    for conv, own in edits.items():
        assert [r.place for r in own] == list(range(len(own)))
        assert "".join(r.edit for r in own) == want[conv][7]
        lines = [f"{r.role}:{r.text}" for r in own if r.edit != "D"]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[conv][8]


def test_long_and_dropped_conversations(spark):
    rng = random.Random(2)
    dropped = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(-1, i, rng.choice(["user", "assistant"]), f"turn {i % 700}" + rng.choice([".", ""])) for i in range(12_000)]
    rows += [(dropped, 0, "user", "gone."), (7_000_000, 1, "user", "x" * 3_000_000 + ".")]
    got = {r.conv_id: tuple(r) for r in conversations.digests(conversations.damaged(spark.createDataFrame(rows, TURNS))).collect()}
    assert got[dropped] == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == expected(rows)


def test_conversations_odd_inputs(spark):
    assert conversations.digests(conversations.damaged(spark.createDataFrame([], TURNS))).count() == 0
    clash = spark.createDataFrame([(1, 1, "user", "Hi.", 5, "x")], TURNS + ", kind int, after string")
    assert conversations.digests(conversations.damaged(clash)).first().audit == conversations.digests(clash.select("conv_id", "turn", "role", "text")).first().audit
    auto = conversations.Automaton()
    assert auto.trace(auto.end, 2 * 2 + 1, conversations.USER) == ("K", conversations.ASSISTANT)


# fill-in-the-middle


def lines_of(text):
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end + 1
        out.append(text[at:end])
        at = end
    return out


def middle(doc_id, text, percent=100, spm=50, seed="7"):
    text = text or ""
    lines = lines_of(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def odd_texts(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "é", "\n", "\r\n", "𝄞", "<", ">", "S", "P>", " ", " ", "'", "é"]) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += ["", None, "\n", "\n\n", "one", "<P>", "x<S>\ny", "a<M>", "a\x00b\nc", "line\n" * 300_000, "z" * 3_000_000]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(None, "no id\nat all", None, None, None)]
    return spark.createDataFrame([*rows, rows[3], rows[3]], DOCS).repartition(3)


def test_fim_against_brute_force(spark, odd_texts):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    text = {r.doc_id: r.text for r in odd_texts.collect()}
    rows = fim.digests(odd_texts).collect()
    assert len(rows) == odd_texts.count()
    for r in rows:
        n, form, p, m, out = middle(r.doc_id, text[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert (r.output_sha256, r.restored_sha256) == (sha(out), sha(text[r.doc_id] or ""))
    assert len({r.form for r in rows}) == 3


def test_fim_texts_are_restored(spark, odd_texts):
    docs = odd_texts.withColumn("fim_form", F.lit(1)).withColumn("nth", F.lit(2)).withColumn("output", F.col("text"))
    out = fim.transformed(docs, percent=60, spm_percent=20, seed="x'y")
    assert out.columns == [*docs.columns, "_fim_form", "fim_text", "fim_prefix_chars", "fim_middle_chars"]
    rows = fim.restored(out, form="_fim_form").collect()
    for r in rows:
        assert r.restored == (r.text or "")
        assert (r["_fim_form"], r.fim_prefix_chars, r.fim_middle_chars, r.fim_text) == middle(r.doc_id, r.text, 60, 20, "x'y")[1:]
    assert fim.transformed(spark.createDataFrame([], DOCS)).count() == 0
    assert fim.digests(spark.createDataFrame([], DOCS)).count() == 0

"""The conversation trie against one that is walked node by node."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string, node string"  # node: a clashing name


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def rebuilt(rows):
    given = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            given.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in given.items()}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        yield c, own.get(c - c % 20, [])[:h] + x[h:]


def brute(rows):
    nodes = {}
    for c, seq in rebuilt(rows):
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append((c, len(seq) == d))
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        members = nodes[path]
        own = (len(members) - 1) * words(path[-1][1]) if path else 0
        below = [v for k, v in out.items() if len(k) == len(path) + 1 and k[: len(path)] == path]
        ends = ",".join(str(c) for c, end in sorted(members) if end)
        first = min(c for c, _ in members)
        parent = min(c for c, _ in nodes[path[:-1]]) if path else None
        out[path] = (first, len(path), parent, len(members), len(below), sum(b[5] for b in below) or 1, own + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


@pytest.fixture
def trie_of(spark, tmp_path):
    numbers = itertools.count()

    def run(rows):
        path = str(tmp_path / str(next(numbers)))
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
        return sorted(map(tuple, convtrie.query(spark, path).collect()), key=repr)

    return run


def some(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(r.randint(1, most)):
            rows.append((c * r.choice([1, 1, 3]), r.choice([turn, turn, None]), r.choice(["user", "user", None, ""]), r.choice(["a b", "a b", "", None, "x\ty z", "é"]), "n"))
    return rows + [(None, 0, "user", "lost", "n")] + rows[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_a_plain_walk(trie_of, seed):
    rows = some(seed, 45, 6)
    assert trie_of(rows) == brute(rows)


def test_long_conversations_in_small_blocks_and_pieces(trie_of, monkeypatch):
    monkeypatch.setattr(convtrie, "BLOCK", 2)
    monkeypatch.setattr(convtrie, "PIECE", 3)
    rows = some(3, 30, 2) + [(7, t, "user", f"w {t}", "n") for t in range(60)] + [(c, t, "user", f"w {t}", "n") for c in (9, 400) for t in range(40)]
    assert trie_of(rows) == brute(rows)


def test_equal_conversations(trie_of):
    rows = [(c, t, "user", f"same {t}", "n") for c in range(200, 260) for t in range(4)]
    assert trie_of(rows) == brute(rows)


def test_empty_table(trie_of):
    assert trie_of([]) == []

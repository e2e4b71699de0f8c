"""The conversation operators against plain Python on generated tables."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

SCHEMA = "conv_id long, turn long, role string, text string, cost double, part string"


def _rows(seed, convs=330):
    rng = random.Random(seed)
    texts = ["Hi.", "How are you?", "Fine", "No!", "", "  \t", None, "漢字 é.", "x " * 3000 + ".", "Bye"]
    out = []
    for c in [*range(convs), 1000, 1001, 2107, -7, -150]:
        if c % 100 == 0 and c % 300:
            continue  # an absent giver
        kind = rng.random()
        n = 0 if kind < 0.03 else rng.randint(1, 8) if kind < 0.97 else rng.randint(40, 90)
        shared = rng.random() < 0.4
        for t in range(n):
            role = "system" if t == 0 and rng.random() < 0.4 else rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            role = rng.choice([None, "", "tool"]) if rng.random() < 0.03 else role
            text = texts[(t * 3) % 10] if shared else rng.choice(texts)
            turn = None if rng.random() < 0.02 else t + (t > 4) * rng.randint(0, 1)
            out.append((c, turn, role, text, 1.0, "p"))
    out += [out[5], out[5]]  # repeated rows
    rng.shuffle(out)
    return out


def _table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _tie(r):
    return (r[1] is not None, r[1] or 0)


def _trie(rows):
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append(r)
    md5 = lambda a, b: hashlib.md5(f"{len(a)}:{a}{b}".encode()).hexdigest()
    own = {c: [(a, b) for _, a, _, b in sorted((_tie(r), r[2] or "", md5(r[2] or "", r[3] or ""), r[3] or "") for r in v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        giver = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(giver, [])[:h] + v[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids.get(p, []))
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest())
        for p, m in nodes.items()
    )


def _got(df, cols):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 7), (3, 40)])
def test_trie(spark, seed, parts):
    from flowtide.llm.prefixtrie import COLUMNS, grafted, sequences, trie

    rows = [*_rows(seed), (None, 0, "user", "lost", 1.0, "p")]
    got = trie(grafted(sequences(_table(spark, rows))), least_partitions=parts)
    assert _got(got, COLUMNS) == _trie(rows)


def test_trie_of_copies_and_of_nothing(spark):
    from flowtide.llm.prefixtrie import COLUMNS, sequences, trie

    rows = [(c, t, "user", "same", 1.0, "") for c in range(9000) for t in range(2)]
    got = _got(trie(sequences(_table(spark, rows))), COLUMNS)
    ids = hashlib.sha256(",".join(map(str, range(9000))).encode()).hexdigest()
    assert [r[:7] for r in got] == [(0, 0, -1, 9000, 1, 1, 2 * 8999 * 4), (0, 1, 0, 9000, 1, 1, 2 * 8999 * 4), (0, 2, 0, 9000, 0, 1, 8999 * 4)]
    assert got[2][7] == ids and got[1][7] == hashlib.sha256(b"").hexdigest()
    assert trie(sequences(_table(spark, rows[:0]))).count() == 0


def _damage(rows):
    out = {}
    for c, t, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(c, [])
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        own += [(t, role, text)] * (2 if fault == 3 else 1)
    return out


def _repair(rows):
    """Dijkstra over (row, state) with (cost, audit) as the distance."""
    seen, faults, count = set(), [], [0, 0, 0]
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        f = 1 if not ink else 2 if (role, text) in seen else 3 if ink[-1] not in ".!?" else 0
        seen.add((role, text))
        faults.append(f)
        if f:
            count[f - 1] += 1
        faults[-1] = (f, bool(ink) and ink[-1] not in ".!?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for c in "ua":
            if c in after:
                heapq.heappush(heap, (cost + 3, audit + "I", i, c, (*made, {"u": "user:", "a": "assistant:"}[c])))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, made))
            if faults[i][0] not in (1, 2):
                more = 3 * faults[i][1]
                if role[:1] and role[:1] in after:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*made, f"{role}:{text}")))
                for c in "ua":
                    if c in after:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, c, (*made, {"u": "user:", "a": "assistant:"}[c] + text)))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


COLS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize(("seed", "null"), [(4, False), (5, True)])
def test_repair(spark, seed, null):
    from flowtide.llm.repair import damaged, repair

    rows = _rows(seed, 200) + ([(None, t, "user", "a lone text.", 0.0, "") for t in range(7)] if null else [])
    md5 = lambda a, b: hashlib.md5(f"{len(a)}:{a}{b}".encode()).digest()
    want = sorted((-1 if c is None else c, *_repair(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), md5(r[1], r[2]))))) for c, v in _damage(rows).items())
    got = repair(damaged(_table(spark, rows)))
    assert _got(got, ["conv_id", *COLS]) == want


def test_repair_of_one_long_conversation(spark):
    from flowtide.llm.repair import damaged, repair

    rows = [(3, t, ("user", "assistant")[t % 2], f"text {t // 5}.", 0.0, "") for t in range(1500)]
    got = repair(damaged(_table(spark, rows))).collect()
    assert [tuple(r[c] for c in COLS) for r in got] == [_repair(sorted(_damage(rows)[3], key=lambda r: r[0]))]
    assert repair(damaged(_table(spark, rows[:0]))).count() == 0


def test_parse_in_any_order():
    from flowtide.llm.repair import NOTHING, combine, leaf, parse

    rng = random.Random(1)
    for _ in range(50):
        cells = [leaf(rng.choice(["s", "u", "a", "t", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 12))]
        left = NOTHING
        for c in cells:
            left = combine(left, c)
        assert left == parse(cells)



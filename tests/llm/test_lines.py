"""Line runs, hard negatives and the Merkle manifest against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from captrail.llm import hardneg, linedups, merkle
from tests.llm.conftest import frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Lines


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def without_common(texts, least, chars):
    split = [(t or "").split("\n") for t in texts]
    n = Counter(k for lines in split for k in {key(x) for x in lines} if len(k) >= chars)
    for lines in split:
        kept = [x for x in lines if len(key(x)) < chars or n[key(x)] < least]
        yield "\n".join(kept), len(lines), len(lines) - len(kept)


@pytest.mark.parametrize(("least", "chars", "batches"), [(3, 1, 4), (2, 4, 3), (1, 1, 1)])
def test_lines(spark, texts, least, chars, batches):
    rows = list(texts.items())
    shared = ["Common LINE", "\tcommon line \r", "common line\x0b", "École", "école", "", "   ", "ab", "once"]
    for k in range(12):
        rows.append((200 + k, "\n".join([shared[k % 3], f"own {k}", shared[3 + k % 2], *shared[5:8], shared[k % 3], ""])))
    rows += [(200, rows[-1][1]), (None, "Common line\nx"), (None, "Common line\nx"), (300, "common line"), (301, "\n" * 3000 + "own 3"), (302, "a\n" * 20_000)]
    got = linedups.drop_common_lines(frame(spark, rows), least, chars, batches).collect()
    want = Counter((i, *x) for (i, _), x in zip(rows, without_common([t for _, t in rows], least, chars), strict=True))
    assert Counter((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in got) == want


def test_lines_of_no_rows(empty):
    assert linedups.drop_common_lines(empty).count() == 0


def test_runs_go_on(spark, tmp_path):
    def batch(*keys):
        return spark.createDataFrame([(k, -k) for k in keys], "h1 long, h2 long")

    runs = linedups.LineRuns(spark, str(tmp_path), least=3, buckets=4)
    assert runs.settled().count() == 0
    runs.add(batch(1, 1, 1, 2))
    runs.add(batch(1, 2, 3, 3))
    assert [level for level, _ in runs.runs] == [1]
    again = linedups.LineRuns(spark, str(tmp_path), least=3)
    assert (again.runs, again.version, again.buckets) == (runs.runs, 2, 4)
    again.add(batch(1, 2, 4))
    assert {r.h1 for r in again.settled().collect()} == {1, 2}
    assert {r.h1 for r in again._read(again.runs[-1][1]).collect()} == {2, 4}, "a settled hash is not counted again"
    (tmp_path / "manifest" / "version=4").mkdir()
    assert linedups.LineRuns(spark, str(tmp_path), least=3).runs == again.runs, "an unfinished version does not count"


def test_runs_merge_without_a_shuffle(spark, tmp_path):
    runs = linedups.LineRuns(spark, str(tmp_path), least=9, buckets=4)
    names = [runs._write(spark.createDataFrame([(k, k, 1)], linedups.RUN).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))) for k in range(2)]
    plan = runs._merged(names)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


# Hard negatives


def test_strassen_is_exact():
    rng = np.random.default_rng(2)
    for m, k, n in ((1, 1, 1), (17, 64, 33), (40, 70, 90), (33, 17, 64)):
        a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
        assert (hardneg.strassen(a, b) == a @ b).all()


def negatives(rows):
    seen = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)
        if all(abs(c) < 10**8 for c in x):
            seen[i, label, x] = None
    out = []
    for a, label, x in seen:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other == label) for i, other, y in seen if i != a)
        for s, positive, _ in [z for z in scored if z[2]][:5]:
            found = [(i, -t) for t, i, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, positive, k, i, -s, t) for k, (i, t) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("part", [8192, 90])
def test_hard_negatives(spark, monkeypatch, part):
    monkeypatch.setattr(hardneg, "PART", part)
    monkeypatch.setattr(hardneg, "STRIP", 3)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=12)
    rows = [(k, [float(x) for x in np.float32(centre + rng.normal(size=12))], int(k % 4)) for k in range(600)]
    rows += [(1000 + k, rows[3][1], k % 4) for k in range(80)]
    rows += [rows[100], rows[7], (100, rows[8][1], 1), (2001, rows[4][1][:5], 2), (2002, [], 1), (2100, [], 1), (2200, [0.0] * 12, 3)]
    rows += [(None, rows[1][1], 1), (3000, None, 1), (3001, rows[1][1], None), (3002, [float("nan")] * 12, 1), (3100, [None, *rows[1][1][1:]], 1), (3003, [float("inf")] * 12, 1), (3200, [1e30] * 12, 1)]
    vectors = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, id int, key string")
    got = Counter(tuple(r) for r in hardneg.mine(vectors).collect())
    assert got == negatives(rows) and len(got) > 100


def test_no_negatives(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hardneg.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], schema)).count() == 0
    assert hardneg.mine(spark.createDataFrame([], schema)).count() == 0
    assert hardneg.mine(spark.createDataFrame([(100, [1.0], 1)], schema)).count() == 0


# Manifest


def tree(nodes):
    """The levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k: k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def path(levels, at):
    for nodes in levels[:-1]:
        low = at // 8 * 8
        yield nodes[low:at], nodes[at + 1: low + 8]
        at //= 8


def leaf(r, text):
    fields = [None if f is None else str(f) for f in (r.doc_id, r.source, r.lang, r.n_chars, text)]
    return sha("".join("-" if f is None else f"{len(f.encode())}:{f}" for f in fields))


def audited(rows):
    by = defaultdict(list)
    for r in rows:
        hit = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 0
        by[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), leaf(r, r.text.translate(LOW) if hit and r.text is not None else r.text), r.doc_id))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(by[x])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    root = top[-1][0]
    for spot, x in enumerate(langs):
        for at, (_, _, own, bad, i) in enumerate(sorted(by[x])):
            steps = [*path(trees[x], at), *path(top, spot)]
            folded = bad
            for left, right in steps:
                folded = sha("".join([*left, folded, *right]))
            yield i, own, trees[x][-1][0], root, sha("".join("".join(left + right) for left, right in steps)), folded, folded == root


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("levels", [3, 1])
def test_manifest(spark, docs, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "RANGES", 100)
    more = frame(spark, [(7 * k - 50, f"Text {k % 9}" if k % 11 else None) for k in range(900)])
    skewed = more.withColumn("lang", F.when(F.col("doc_id") % 5 > 0, "en").when(F.col("doc_id") % 25 > 0, F.concat(F.lit("l"), F.abs("doc_id") % 13)))
    rows = docs.union(skewed)
    got = Counter(tuple(r[c] for c in NAMES) for r in merkle.audit(rows).collect())
    assert got == Counter(audited(rows.collect()))
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 73])
def test_manifest_of_one_language(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 0 if n == 73 else 1)
    rows = frame(spark, [(k, "Aa") for k in range(n)]).withColumn("lang", F.lit("en"))
    assert Counter(tuple(r[c] for c in NAMES) for r in merkle.audit(rows).collect()) == Counter(audited(rows.collect()))


def test_manifest_of_no_rows(empty):
    assert merkle.audit(empty).count() == 0

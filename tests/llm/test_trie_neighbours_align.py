"""Prefix tries, nearest neighbours and cross-tokenizer alignment against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from larder.llm import align, neighbours, queries, trie
from pyspark.sql import functions as F

A, B = public_tokenizers.path(queries.TOKENIZER), public_tokenizers.path(queries.PIECES)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

# --- prefix trie ---


def trie_by_hand(rows):
    """Nodes as tuples of whole turns, subtrees by walking."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h, rest = zlib.crc32(str(c).encode()) % 4, int(np.fmod(c, 20))
        built = tuple(own.get(c - rest, [])[:h] + own[c][h:])
        ends[built].append(c)
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
    children = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(m) - 1) * len(WORD.findall(s[-1][1])) if s else 0
            leaves[s[:d]] += not children[s]
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], sha(",".join(map(str, sorted(ends[s]))))) for s, m in members.items())


NODE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def trie_rows(df):
    return sorted(tuple(r[c] for c in NODE) for r in df.select(NODE).collect())


def conversations():
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 2, 3, 20, 21, 22, 25, 41, 60, -1, -20, -21, None, 1 << 40]), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(["u", "a", None]), rng.choice([None, "", "x y", "z", "x  y"])) for _ in range(250)]
    same = [(1000 + k, t, "u", f"same {t}") for k in range(60) for t in range(5)]
    long = [(500, t, "u", "on and on") for t in range(1500)] + [(520, 0, "u", "w " * 200_000)] * 2
    return rows + same + long


def test_trie_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    clash = df.withColumns({c: F.lit("q") for c in ("block", "depth", "k1", "d1", "i", "h", "n", "at", "own", "leaf", "_tie", "_at", "words", "x0")})
    assert trie_rows(trie.prefix_trie(clash)) == trie_by_hand(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0
    assert trie_rows(trie.prefix_trie(df.filter("conv_id IS NULL"))) == []


def test_trie_of_a_turnless_conversation(spark):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(c, 0, "u", "skipped"), (c + 20 * 5, None, None, None)]
    got = trie_rows(trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == trie_by_hand(rows) and got[0][7] != sha("")


def test_trie_colliding_digests_are_found(spark, monkeypatch):
    """Weak digests or primes don't change the result: the check fails and the next ones are taken."""
    rows = conversations()[:250]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tried = []
    true = trie.digests_hold
    monkeypatch.setattr(trie, "digests_hold", lambda turns, salt: tried.append(salt) or (salt > 0 and true(turns, salt)))
    assert trie_rows(trie.prefix_trie(df)) == trie_by_hand(rows) and tried == [0, 2]


def test_weak_fingerprints_are_refused(spark, monkeypatch):
    """With bases of 1 a fingerprint forgets the order of turns; nodes then differ in their last turn, and are refused."""
    rows = [(0, 0, "u", "a"), (0, 1, "u", "b"), (60, 0, "u", "b"), (60, 1, "u", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    real, used = trie._base, []
    monkeypatch.setattr(trie, "_base", lambda lane, salt: used.append(salt) or (1 if salt == 0 else real(lane, salt)))
    assert trie_rows(trie.prefix_trie(df)) == trie_by_hand(rows) and set(used) == {0, 2}


def test_many_slices_of_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "SLICE", 4)
    rows = [(k, 0, "u", "same") for k in range(-30, 60)]
    assert trie_rows(trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == trie_by_hand(rows)


# --- nearest neighbours ---


def nearest_by_hand(rows, k):
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (q, a) in enumerate(good):
        if q is None or q % 20:
            continue
        found = []
        for m, (i, b) in enumerate(good):
            if m != n and len(a) == len(b):
                total = 0.0
                for x, y in zip(a, b, strict=True):
                    total += x * y
                found.append((-total, i is None, i))
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return Counter(out)


def hits(df):
    return Counter((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize(("kind", "block"), [("float", 16_384), ("float", 3), ("double", 7)])
def test_nearest_brute_force(spark, kind, block):
    rng = np.random.default_rng(5)
    some = [rng.normal(size=6).astype(np.float32).astype(float).tolist() for _ in range(300)]
    rows = list(enumerate(some)) + [(1000 + k, some[3]) for k in range(150)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2020, []), (2040, [0.0] * 6), (2060, [1.0, None] * 3), (2080, [nan] * 6), (2100, [inf] + [1.0] * 5), (2120, [2.0]), (2121, [-2.0]), (2140, [1.0] * 7), (None, some[3]), (None, None), (20, some[3]), (20, some[5])]
    rows += [(3000, [1e-30] * 6), (3001, [5e-45 if kind == "float" else 5e-324] * 6), (4000, [0.5] * 2000), (4001, [0.25] * 2000)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5).withColumns({c: F.lit("q") for c in ("id", "query", "row", "_row", "code", "score", "rank", "_tile", "v")})
    assert hits(neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20, block=block)) == nearest_by_hand(rows, 20)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert neighbours.nearest(df, F.lit(True)).count() == 0
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_bounds_hold():
    """No pair's inner product lies outside its bounds, so nothing that belongs to the result is pruned."""
    rng = np.random.default_rng(9)
    for scale in (1e-3, 1.0, 1e6):
        x, y = rng.normal(size=(200, 33)) * scale, rng.standard_cauchy(size=(300, 33))
        parts = []
        for m in (x, y):
            step = np.abs(m).max(1) / 127
            code = np.rint(m / step[:, None])
            parts.append((step, code, m - code * step[:, None]))
        (s, c, r), (t, d, u) = parts
        norm = np.linalg.norm
        error = np.outer(norm(r, axis=1), norm(d * t[:, None], axis=1)) + np.outer(norm(x, axis=1), norm(u, axis=1))
        assert (np.abs(x @ y.T - np.outer(s, t) * (c @ d.T)) <= error * (1 + 1e-12) + 1e-12).all()


# --- alignment ---

TEXTS = [
    None, "", " ", "x", "a b c", "a b c", "  a\n\nb  ", "<|endoftext|> <s> </s>", "é漢字🙂 ﬁ ½  　", "▁▁x", "\x00\x01\t", "<0x41> A",
    "The quick brown fox; don't 12345 it's" * 20, "w" * 3000, "Straße für Überläufer, çà et là. " * 3000, "漢字 " * 500, "x" * 5000,
]


def align_by_hand(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    bytes_a, bytes_b = align.byte_level_tokens(A), align.piece_tokens(B)
    rows, counts = [], Counter()
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if b"".join(bytes_a[i] for i in ids_a) != whole or b"".join(bytes_b[i] for i in ids_b) != whole:
            rows.append(None)
            continue
        at_a = np.cumsum([len(bytes_a[i]) for i in ids_a]).tolist()
        at_b = np.cumsum([len(bytes_b[i]) for i in ids_b]).tolist()
        in_a, in_b = dict(zip(at_a, range(len(at_a)), strict=True)), dict(zip(at_b, range(len(at_b)), strict=True))
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(in_a) & set(in_b)):
            groups.append(",".join(map(str, ids_a[i : in_a[e] + 1])) + "|" + ",".join(map(str, ids_b[j : in_b[e] + 1])))
            links.append((ids_a[in_a[e]], ids_b[in_b[e]]))
            i, j = in_a[e] + 1, in_b[e] + 1
        counts.update(links)
        rows.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0,) * 6 + ("",) if r is None else (*r[:3], len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in rows], counts


COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups".split()


def test_align_brute_force(spark):
    want, _ = align_by_hand(TEXTS)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4).withColumns({c: F.lit("q") for c in (*COLUMNS, "_d", "_t", "links", "pair", "best")})
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.align_counted(df, A, B).collect()}
    assert got == dict(enumerate(want))
    digests = {r["doc_id"]: r["groups"] for r in align.align_counted(df, A, B, groups="sha256").collect()}
    assert digests == {k: w[6] and sha(w[6]) for k, w in enumerate(want)}
    assert align.align_counted(df.limit(0), A, B).count() == 0
    assert align.align_counted(df.filter("text IS NULL"), A, B).select("n_a", "groups").collect() == [(0, "")]


def test_query_alignment_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want, _ = align_by_hand([r["text"] for r in docs])
    got = {r["doc_id"]: tuple(r[c] for c in [*COLUMNS[:-1], "groups_sha256"]) for r in queries.op13_alignment(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: (*w[:6], w[6] and sha(w[6])) for r, w in zip(docs, want, strict=True)}


def test_linked_pairs_are_bounded_by_the_vocabularies():
    a, b = align.byte_level_tokens(A), align.piece_tokens(B)
    _, counts = align_by_hand(TEXTS)
    assert all(a[x].endswith(b[y]) or b[y].endswith(a[x]) for x, y in counts)
    small_a, small_b = [b"a", b"ba", b"c", b"aba"], [b"a", b"a", b"ba", b"ccc"]
    assert align.pair_bound(small_a, small_b) == sum(x.endswith(y) or y.endswith(x) for x in small_a for y in small_b)


def test_fast_encoder_is_the_library():
    """Every code point that the fast way may see, in every surrounding that the pattern tells apart, and long runs."""
    from tokenizers import Tokenizer

    library, fast = Tokenizer.from_file(A), align.fast_encoder(A)
    library.encode_special_tokens = True
    around = ["{0}", "a{0}b", "1{0}2", " {0} ", "  {0}x", "{0}{0}{0}", "'{0}", "!{0}.", "x {0}1\n{0}", "it's{0}'ll<|endoftext|>{0}"]
    texts = [w.format(chr(c)) for c in range(0x250) for w in around] + ["w" * 900, " " * 900 + "x", "ab1 " * 5000]
    assert [list(map(int, fast(t))) for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert align.UNUSUAL("x" * 1000) and align.UNUSUAL("漢") and align.UNUSUAL("a" + "\n" * 1000) and not align.UNUSUAL("été " * 5000)
    assert align.fast_encoder(public_tokenizers.path("word_bpe_49k.json")) is None


def test_shared_ends_by_divide_and_conquer():
    rng = np.random.default_rng(2)
    for n, share in [(1, 1), (2, 0.5), (50, 0.1), (400, 0.3), (3000, 0.9), (3000, 0.01)]:
        ends = np.arange(1, 5 * n + 1)
        a, b = (np.unique(np.append(rng.choice(ends, max(1, int(len(ends) * share))), ends[-1])) for _ in range(2))
        i, j = align.shared_ends(a, b, np.array([0]), np.array([len(a)]))
        assert sorted(a[i]) == sorted(b[j]) == sorted(set(a) & set(b)) and (a[i] == b[j]).all()

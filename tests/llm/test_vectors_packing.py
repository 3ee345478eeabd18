"""Vector codes, whitening and packing next to brute force, with the odd cases."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from skillgrid.llm import packing, vector_codes, whitening

# names of further columns are names that the operators use inside
VECTORS = "vec_id long, embedding array<float>, label int, i string, l string, x array<int>, code int, n int"
DOCS = "doc_id long, text string, row int, ids string, kind string, doc int, t string"


def vectors(spark, rows):
    return spark.createDataFrame([(a, v, g, "i", "l", [1], 3, 4) for a, v, g in rows], VECTORS)


def documents(spark, rows):
    return spark.createDataFrame([(a, t, 1, "i", "k", 2, "t") for a, t in rows], DOCS)


def odd_vectors(width=16, n=300, seed=3):
    """Clustered rows with repeats, null ids and labels, short and empty vectors, and rows that have to go."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    rows = [(int(k), (centres[k % 9] * (1 + k % 4) + rng.normal(size=width) * 0.2).astype("f4").tolist(), None if k % 7 == 0 else int(k % 3)) for k in rng.permutation(n)]
    rows += [rows[0], rows[1], (rows[2][0], rows[5][1], 9), (None, rows[3][1], 1), (1000, [0.5] * (width - 3), 1), (1001, [], None)]
    bad = [(2000, None, 1), (2001, [None] + [0.0] * (width - 1), 1), (2002, [math.nan] + [0.0] * (width - 1), None), (2003, [math.inf] + [0.0] * (width - 1), 2)]
    return rows, bad


def filled(rows, width, scale):
    v = np.zeros((len(rows), width))
    for k, (_, x, _) in enumerate(rows):
        v[k, :len(x)] = np.array(x, "f4").astype(float)
    return np.floor(v * scale).astype(np.int64)


def nearest(q, entries):
    d = ((q[:, None] - entries[None]) ** 2).sum(-1)
    return d.argmin(1), d.min(1)


def test_orchard_search_finds_the_lowest_of_the_nearest():
    rng = np.random.default_rng(1)
    for k, d, top in ((1, 2, 9), (2, 1, 3), (16, 2, 4), (40, 3, 60), (64, 8, 4096)):
        entries, queries = rng.integers(-top, top, (k, d)), rng.integers(-top, top, (500, d))
        entries[k // 2] = entries[0]  # equal entries
        found, far = vector_codes.Orchard(entries).nearest(queries)
        want, distance = nearest(queries, entries)
        assert (found == want).all() and (far == distance).all()


def test_vector_codes_are_those_of_brute_force(spark):
    rows, bad = odd_vectors()
    out, books = vector_codes.encode(vectors(spark, rows + bad).repartition(5))
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"]
    got = Counter(tuple(r) for r in out.collect())
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, filled(rows, 16, 4096)[k].tolist()))
    x = filled(rows, 16, 4096)[order]
    parts = np.split(x, 8, axis=1)
    entries = [p[:16].copy() for p in parts]
    for _ in range(6):
        for p, e in zip(parts, entries):
            near, _ = nearest(p, e)
            for j in range(16):
                if (near == j).any():
                    e[j] = p[near == j].sum(0) // (near == j).sum()
    found = [nearest(p, e) for p, e in zip(parts, entries)]
    error = sum(f[1] for f in found)
    labels = [rows[k][2] for k in order]
    total = Counter()
    for g, e in zip(labels, error.tolist()):
        total[g] += e
    want = Counter((rows[k][0], g, "".join(f"{f[0][at]:02x}" for f in found), int(error[at]), total[g]) for at, (k, g) in enumerate(zip(order, labels)))
    assert got == want
    assert books.sha256() == hashlib.sha256(",".join(str(v) for e in entries for row in e for v in row).encode()).hexdigest()
    assert len(books.decode(next(iter(got))[2])) == 16


def test_vector_codes_of_few_rows_no_rows_and_far_numbers(spark):
    out, books = vector_codes.encode(vectors(spark, [(2, [1.0] * 8, 1), (1, [3e38] + [0.0] * 7, 1), (1, [3e38] + [0.0] * 7, None)]))
    assert books.entries.shape == (8, 3, 1) and out.count() == 3
    assert {r["error"] for r in out.collect()} == {0} and {r["code"] for r in out.collect()} == {"00" * 8, "02" + "02" * 7}
    for rows in ([], odd_vectors()[1]):
        out, books = vector_codes.encode(vectors(spark, rows))
        assert books is None and out.count() == 0 and out.columns == ["vec_id", "label", "code", "error", "label_error"]
    out, _ = vector_codes.encode(vectors(spark, [(1, [], None), (2, [], 4)]))
    assert sorted((r["vec_id"], r["error"], r["label_error"]) for r in out.collect()) == [(1, 0, 0), (2, 0, 0)]


@pytest.mark.parametrize("width,n", [(5, 200), (60, 700), (90, 900)])
def test_whitening_is_that_of_a_full_eigenvalue_problem(spark, width, n):
    """Wide tables run the filtered iteration (the block is smaller than the space), the narrow one is solved at once."""
    rows, bad = odd_vectors(width, n)
    out, fit = whitening.whiten(vectors(spark, rows + bad).repartition(3), components=8)
    assert (fit.passes == 1) == (width <= 24) and fit.residual <= 1e-11
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = filled(rows, width, 64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    values, v = np.linalg.eigh(c.T @ c / n)
    values, v = values[::-1][:8], v[:, ::-1][:, :8]
    z = c @ v / np.sqrt(values)
    k = z.shape[1]
    got = out.collect()
    assert len(got) == n * k and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    signs = np.sign([[r["whitened"] for r in got if r["vec_id"] == 1000][j] * z[-2][j] for j in range(k)])
    want = Counter((rows[i][0], j + 1, int(((n * x[i] - s) ** 2).sum()), round(float(z[i, j] * signs[j]), 6) + 0.0) for i in range(n) for j in range(k))
    assert Counter((r["vec_id"], r["component"], r["deviation"], round(r["whitened"], 6) + 0.0) for r in got) == want
    share = values / np.trace(c.T @ c / n)
    assert all(abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9 for r in got)


def test_whitening_without_variance_has_no_rows(spark):
    for rows in ([], odd_vectors()[1], [(1, [0.5, 1.0], 1)], [(1, [2.0], 1), (2, [2.0], 1)], [(1, [], 1)]):
        out, _ = whitening.whiten(vectors(spark, rows))
        assert out.count() == 0 and "identity_error" in out.columns
    out, fit = whitening.whiten(vectors(spark, [(1, [1.0, 0.0], 1), (2, [3.0, 0.0], 1)]))  # one flat dimension
    assert len(fit.values) == 1 and sorted(abs(r["whitened"]) for r in out.collect()) == [1.0, 1.0]
    out, _ = whitening.whiten(vectors(spark, [(1, [3e38], 1), (2, [-3e38], 1)]))  # deviations that still fit
    assert [r["deviation"] for r in out.collect()] == [(1 << 31) ** 2, (1 << 31) ** 2]


def test_words_alone_have_the_ids_of_their_text():
    texts = ["Don't stop, it's 42!!", "a b ́x J̌A İK ΣΑΣ", "x\x01y \x01", "", None, "w" * 300 + " tail", "<|endoftext|> a <|startoftext|>b", "tab\tline\r\nend.", "'s 's. .'s don''t",
             "été naïve ÇA", "日本語 テスト 👍🏽 x", "A" * 63 + " " + "A" * 64 + " " + "A" * 65, " \n "]
    encoder = packing.WordEncoder(packing.vocabulary_path())
    library = Tokenizer.from_file(packing.vocabulary_path())
    for _ in range(2):  # the second time from the kept words
        ids, begin = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_scores_are_bm25():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 30, n) for n in (5, 40, 1, 25, 90)]
    weight = rng.random(30)
    index = packing.Shard(docs, weight, 32.2)
    for q in range(len(docs)):
        for d, score in enumerate(index.scores(q)):
            count = Counter(docs[d].tolist())
            want = sum(weight[t] * count[t] * 2.2 / (count[t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / 32.2)) for t in set(docs[q].tolist()))
            assert abs(score - want) < 1e-9


@pytest.mark.parametrize("window,shard", [(64, 500), (4096, 1 << 19)])
def test_packing_holds_every_token_once(spark, window, shard):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "mot", "phrase", "été", "Wort", "Satz,", "über", "x1"]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(0, 120))))) for k in range(200)]
    rows += [rows[0], rows[0], (None, "no id"), (None, None), (500, ""), (501, "long text, " * 3000), (502, "<|endoftext|> y"), (503, " ".join(["beta"] * (window - 1)))]
    got = packing.pack(documents(spark, rows).repartition(4), window=window, shard_tokens=shard, task_tokens=2000)
    pieces = got.pieces.collect()
    library = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter((a, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for a, t in rows)
    ids = {r["row"]: (r["doc_id"], tuple(np.frombuffer(r["ids"], "<u2").tolist())) for r in got.documents.collect()}
    assert Counter(ids.values()) == want
    by_row, by_sequence = {}, {}
    for p in pieces:
        by_row.setdefault(p["row"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        doc, tokens = ids[p["row"]]
        assert p["doc_id"] == doc and p["doc_tokens"] == len(tokens)
        assert p["ids_crc32"] == zlib.crc32(np.array(tokens[p["start"]:p["start"] + p["length"]], "<u4").tobytes())
    for parts, place, whole in ((by_row, "start", None), (by_sequence, "offset", window)):
        for key, own in parts.items():
            at = 0
            for p in sorted(own, key=lambda p: p[place]):
                assert p[place] == at and p["length"] > 0
                at += p["length"]
            assert at == len(ids[key][1]) if whole is None else at <= whole and (at == whole or at & (at - 1) == 0)
    sizes = sorted(sum(p["length"] for p in own) for own in by_sequence.values())
    assert sum(s < window for s in sizes) <= window.bit_length() and sorted(by_sequence) == list(range(len(by_sequence)))
    made = {r["sequence_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in got.sequences().collect()}
    assert made == {key: [t for p in sorted(own, key=lambda p: p["offset"]) for t in ids[p["row"]][1][p["start"]:p["start"] + p["length"]]] for key, own in by_sequence.items()}


def test_windows_hold_lexical_neighbours(spark):
    """Two vocabularies, dealt by turns: nearly all windows hold documents of one of them."""
    rng = np.random.default_rng(7)
    sides = (["one", "two", "three", "four", "five", "six"], ["eins", "zwei", "drei", "vier", "sechs", "sieben"])
    rows = [(k, " ".join(rng.choice(sides[k % 2], 20))) for k in range(400)]
    own = {}
    for p in packing.pack(documents(spark, rows), window=128, shard_tokens=4000).pieces.collect():
        own.setdefault(p["sequence_id"], set()).add(p["doc_id"] % 2)
    assert sum(len(s) == 1 for s in own.values()) >= 0.9 * len(own)


def test_packing_of_an_empty_table(spark):
    got = packing.pack(documents(spark, []))
    assert got.pieces.count() == 0 and got.pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row"] and got.sequences().count() == 0

"""The corpus operators next to brute force, round trips and held-out rows, on small tables with the odd cases."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillgrid.llm import decontam, language, licenses, line_dedup, near_dedup, pieces, pii, quality, token_file, toxicity
from skillgrid.llm.charlm import collect, count_grams, smooth
from skillgrid.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# columns beyond doc_id, text and lang have names that the operators use inside
SCHEMA = "doc_id long, text string, lang string, n long, kept string, h int, component string"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, None, None, 1, "c") for i, t, g in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Given documents with nulls, empty and long texts, repeated rows and unusual characters."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [rows[3], (10_000, rows[5][1], None), (10_001, None, "en"), (10_002, "", None), (10_003, " \t\n ", "en"), (None, "no id here a@b.co", "en"), (None, None, None),
             (10_004, "word " * 30_000, "en"), (10_005, "é 𝄞 +1 (499) 555-6503\n\nx@y.z_foo@q.r 4111 1111 1111 1111", "fr"), (10_006, "1 " * 9_000 + "1.2.3.4.5.6.7.8", "xx"),
             (10_007, "a  b\n \n c\t d <|endoftext|> x", "en"), (10_008, "one▁two", "en")]
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(got):
    return sorted(map(repr, got))


def test_components_of_chain_and_hub(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 160)}


def test_models_sum_to_one(spark):
    docs = spark.createDataFrame([("abab", "x"), ("abcab", "x")], "t string, g string")
    for modified in (False, True):
        rows = smooth(count_grams(docs, "t", "g", 3), 3, modified)
        model = collect(rows, 3, 20)
        for context in ([0, 0], [97, 98], [98, 99], [122, 122]):
            total = 0.0
            for c in (97, 98, 99, 5000):
                codes = np.array([*context, c], np.uint32)
                total += math.exp(float(model.log_probs(codes, np.array([2]), 0)[0]))
            assert total == pytest.approx(1, abs=1e-5)


def rules(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for j in range(k, k + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_quality_rules(odd, empty):
    got = quality.quality(odd).collect()
    texts = odd.select("doc_id", "text").collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert by_row((r["doc_id"], *[r[c] for c in cols]) for r in got) == by_row((i, *rules(t)) for i, t in texts)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    good = [r for r in got if not r["base_failed"]]
    assert sum(r["kept"] for r in good) > 0.95 * len(good)
    assert quality.quality(empty).count() == 0
    assert quality.keep_good(odd).columns == odd.columns


def test_perplexity_bands_reject_junk(spark):
    """Gibberish and over-repetitive text of each language goes, also if one hot source is full of it; clean rows stay."""
    rng = np.random.default_rng(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    texts = docs.collect()
    clean = {r["doc_id"] for r in texts if sum(map((r["text"] or "").count, "#*$%&|<>")) == 0}
    plant, letters = [], list("abcdefghijklmnopqrstuvwxyz")
    for k, g in enumerate(sorted({r["lang"] for r in texts})):
        top = [w for w, _ in Counter(w for r in texts if r["lang"] == g for w in r["text"].split()).most_common(2)]
        for j in range(3):
            plant.append((20_000 + 10 * k + j, " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(80)), g, f"src{j}"))
            plant.append((30_000 + 10 * k + j, " ".join(rng.choice(top, 120)), g, f"src{j}"))
    plant += [(40_000 + j, " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(80)), "en", "hot") for j in range(600)]
    got = {r["doc_id"]: r for r in quality.quality(docs.unionByName(spark.createDataFrame(plant, docs.schema))).collect()}
    assert [i for i, *_ in plant if got[i]["kept"] or got[i]["perplexity_low"] <= got[i]["perplexity"] <= got[i]["perplexity_high"]] == []
    good = [i for i in clean if not got[i]["base_failed"]]
    assert sum(got[i]["kept"] for i in good) > 0.97 * len(good)


def normal(line):
    import unicodedata
    folded = "".join("0" if unicodedata.category(c)[0] == "N" else c for c in line.lower())
    return " ".join("".join(c if c == "0" or unicodedata.category(c)[0] in "LM" else " " for c in folded).split())


def test_fuzzy_lines(spark, odd, empty):
    base = "the quick brown fox jumps over the lazy dog while seven old men sit by the river and watch boats pass under the stone bridge at noon"
    rows = [(1, f"{base}\nshort\n***", "en"), (2, f"{base.upper()}!\nother line\n***", "en"), (3, None, "en"), (4, base.replace("noon", "noons"), "en"), (5, "", "en")]
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_report(frame(spark, rows)).collect()}
    assert got[1] == [] and got[2] == [0] and got[3] == [] and got[5] == []
    report = {r["doc_id"]: (r["n_lines"], set(r["dropped"])) for r in line_dedup.line_report(odd).collect() if r["doc_id"] is not None}
    first = {}
    for i, text in sorted({(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect() if r["doc_id"] is not None and r["text"]}):
        for pos, line in enumerate(text.split("\n")):
            key = normal(line)
            if not key:
                assert pos not in report[i][1]
            elif key in first:
                assert pos in report[i][1], (i, pos)
            else:
                first[key] = (i, pos)
    out = line_dedup.dedup_lines(odd)
    assert set(odd.columns) < set(out.columns) and out.count() == odd.count()
    assert line_dedup.line_report(empty).count() == 0


def test_simhash_ways_agree(spark):
    lines = spark.createDataFrame([(1, k, 0, " ".join(f"w{j % 97}" for j in range(n))) for k, n in enumerate((1, 2, 126, 127, 128, 300, 17_000))], "i long, k long, pos int, line string").withColumn("h", F.xxhash64("line"))
    grouped = {r["h"]: r["fp"] for r in line_dedup._fingerprints(lines).collect()}
    assert grouped == {r["h"]: r["f"] for r in lines.select("h", line_dedup.simhash(F.split("line", " ")).alias("f")).collect()}


def test_far_lines_of_a_large_block_still_meet(spark):
    """Pairs that meet no leader are found by the second round."""
    fp = 0x1234_5678_9ABC_DEF0
    members = spark.createDataFrame([(h, fp ^ flip, 7, 4) for h, flip in ((1, 0), (2, 1 << 50), (3, 1 << 51), (4, 0b111 << 60))], "h long, fp long, key long, many long")
    none = spark.createDataFrame([], "node long, component long")
    got = {(r["u"], r["v"]) for r in line_dedup._apart(members.withColumn("key", F.lit(0).cast("long")), none).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 4)}


def test_near_duplicates(spark, odd, empty):
    words = [f"w{k}" for k in range(60)]
    near = [(20_000 + k, " ".join(words[:60 - k]), "en") for k in range(12)]
    docs = odd.unionByName(frame(spark, near))
    sets = {}
    for i, t in docs.select("doc_id", "text").collect():
        w = WORD.findall((t or "").translate(LOWER))
        sets.setdefault(i, []).append(frozenset(tuple(w[k:k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    got = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == {i: (max(map(len, sets[i])), root(i), root(i) == i) for i in ids}
    assert sum(r["doc_id"] is None for r in got) == 2 and all(r["kept"] for r in got if r["doc_id"] is None)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_large_groups_are_compared_in_blocks(spark):
    rows = [(k, " ".join([f"x{j}" for j in range(120)] + [f"y{k}"]), "en") for k in range(300)] + [(k, " ".join(f"z{k}_{j}" for j in range(20)), "en") for k in range(300, 320)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert all(got[k] == 0 for k in range(300)) and all(got[k] == k for k in range(300, 320))


def bag(words):
    return Counter(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4)))


def test_benchmark_leaks(spark, odd, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame([(900, "One Two three"), (901, None), (902, ""), (903, "a b a b a b a b a b a b")], "item_id long, text string"))
    lists = {r["item_id"]: WORD.findall((r["text"] or "").lower()) for r in items.collect()}
    some = lists[0]
    docs = odd.unionByName(frame(spark, [(30_000, "begin one two three end", "en"), (30_001, "x y z " + " ".join(some[:-1]) + " changed", "en"), (30_002, "a b a b a b a b a b a b c", "en")]))
    want = {}
    for i, t in docs.select("doc_id", "text").collect():
        words = WORD.findall((t or "").lower())
        for item, w in lists.items():
            known = bag(w) if w else None
            for s in range(len(words) - len(w) + 1 if w else 0):
                if len(w) >= 5 and not any(words[s + j] == w[j] for j in range(len(w))) and item != 903:
                    continue
                here = bag(words[s:s + len(w)])
                both, either = sum((here & known).values()), sum((here | known).values())
                if 100 * both >= 80 * either:
                    want[i, item] = max(want.get((i, item), 0), both / either)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.leaks(docs, items).collect()}
    assert got.keys() >= {(30_000, 900), (30_002, 903)} and got == pytest.approx(want)
    assert decontam.leaks(empty, items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0
    assert decontam.drop_leaks(docs, items).columns == docs.columns


def segmentations(vocab, text):
    out, chars = [], "▁" + text.replace(" ", "▁")
    known = {vocab.pieces[k]: (k, w) for k, w in enumerate(vocab.logp) if np.isfinite(w)}

    def go(at, ids, w):
        if at == len(chars):
            out.append((tuple(ids), w))
        for end in range(at + 1, min(len(chars), at + vocab.longest) + 1):
            if chars[at:end] in known:
                k, x = known[chars[at:end]]
                go(end, [*ids, k], w + x)
            elif end == at + 1:
                raw = chars[at].encode()
                go(end, [*ids, *vocab.bytes[list(raw)]], w + len(raw) * vocab.byte_logp)

    go(0, [], 0.0)
    return out


def test_samples_follow_the_lattice():
    vocab = pieces.Vocabulary(pieces.model_path(), 1.0)
    for text in ("the a", "cat é𝄞", "a  b "):
        every = segmentations(vocab, text)
        total = np.logaddexp.reduce([w for _, w in every])
        chance = {tuple(map(int, ids)): math.exp(w - total) for ids, w in every}
        n = 4000
        got, threshold = pieces.Sampler(pieces.Net(vocab), pa.array([text] * n), pieces.scramble(np.arange(n, dtype=np.uint64)), 2).run()
        drawn = [[tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])] for _, _, _, ids, bounds in got]
        assert all(a != b for a, b in zip(*drawn)) and (got[0][1] >= got[1][1]).all() and (got[1][1] >= threshold).all()
        for ids, w in zip(drawn[0][:50], got[0][2]):
            assert w == pytest.approx(math.log(chance[ids]), abs=1e-4) and vocab.decode(ids) == text
        first, second = Counter(drawn[0]), Counter(drawn[1])
        for ids in sorted(chance, key=chance.get)[-3:]:
            assert first[ids] / n == pytest.approx(chance[ids], abs=0.03)
            assert second[ids] / n == pytest.approx(sum(chance[o] * chance[ids] / (1 - chance[o]) for o in chance if o != ids), abs=0.03)


def test_sampled_pieces_round_trip(odd, empty):
    got = pieces.sample(odd, k=3).collect()
    texts = {(r["doc_id"], (r["text"] or "").replace("▁", " ")) for r in odd.select("doc_id", "text").collect()}
    assert all((r["doc_id"], r["decoded"]) in texts for r in got)
    assert {(r["doc_id"], r["decoded"]) for r in got if r["rank"] == 1} == texts
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["decoded"]), set()).add(tuple(r["ids"]))
    assert all(len(by[i, t]) == 3 for i, t in by if len(t) > 20 and i != 10_006)  # "1 1 1 ..." has one segmentation only
    assert pieces.sample(empty).count() == 0


def test_token_file(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(token_file.vocabulary_path())
    path = str(tmp_path / "file")
    got = token_file.round_trip(odd, path=path).orderBy("start").collect()
    want = []
    for r in odd.select("doc_id", "text").collect():
        raw = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        want.append((r["doc_id"], len(raw) // 4, zlib.crc32(raw)))
    assert by_row((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == by_row(want)
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert token_file.round_trip(empty).count() == 0
    damaged = spark.read.parquet(f"{path}/blocks").withColumn("crc", F.col("crc") + 1)
    damaged.write.parquet(f"{tmp_path}/bad/blocks")
    spark.read.parquet(f"{path}/frequencies").write.parquet(f"{tmp_path}/bad/frequencies")
    with pytest.raises(Exception, match="damaged"):
        token_file.read_documents(spark, f"{tmp_path}/bad").collect()


def test_coder_decodes_from_checkpoints():
    freq = np.array([5, 0, (1 << token_file.PRECISION) - 6, 1], np.uint32)
    ids = np.random.default_rng(1).choice([0, 2, 3], 150_001).astype(np.uint32)
    coder, step = token_file.Coder(freq), token_file.CHECKPOINT_STEPS
    states, words, marks, places = coder.encode(ids)
    assert (coder.decode(len(ids), states, words) == ids).all()
    for k in range(len(marks)):
        part = coder.decode(len(ids), marks[k], words, step * (k + 1), places[k], step * (k + 2))
        assert (part == ids[step * (k + 1) * coder.lanes:step * (k + 2) * coder.lanes]).all()


def test_languages(spark, odd, empty):
    got = language.identify(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    known = {r["doc_id"]: r["lang"] for r in odd.collect()}
    out = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 10_000]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in out) > 0.95 * len(out)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und" and r["rejected"]} >= {10_001, 10_002, 10_003, 10_006}
    assert language.identify(empty).count() == 0
    alone = language.identify(frame(spark, [(1, "abc", None), (2, None, "en")])).collect()
    assert all(r["lang_pred"] == "und" for r in alone)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) * (1 + n % 2) - 9 * (int(c) * (1 + n % 2) > 9) for n, c in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(spark, odd, empty):
    more = [(40_000, "mail me joe [at] site [dot] com tel 0499 555 6503", "en"), (40_001, "256.1.1.1 +12 a@b@c.d 4111-1111-1111-1111 1.02.003.4", "en")]
    docs = odd.unionByName(frame(spark, more))
    got = pii.report(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    want = []
    for r in rows:
        spans = base_spans(r["text"])
        text = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        want.append((r["doc_id"], *[sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(text.encode()).hexdigest()))
    assert by_row((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == by_row(want)
    for r in got:
        assert len(r["spans"].split(",")) * bool(r["spans"]) >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]
    assert pii.report(empty).count() == 0


def test_votes_are_weighed():
    patterns = [("phone", (1, 1, 1, 1), 50), ("phone", (1, 1, -1, 1), 200), ("phone", (0, 0, -1, 0), 100), ("phone", (0, 1, 1, 1), 20), ("phone", (0, 0, -1, 1), 80)]
    post = pii.reliabilities(patterns)["phone"]
    assert post[0] > 0.95 and post[1] > 0.9 and post[2] < 0.1 and post[3] > post[4]
    weights = pii.train(patterns)
    assert weights["phone"][1] > 0 and weights["email"] == [0.0] * 5


def test_toxicity(spark, odd, empty):
    rows = [(k, f"plain words number {k} here we go " + ("idiot moron trash " if k % 3 == 0 else "nice good fine ") * 3, "en") for k in range(150)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(100)] + [(5, 1, 0), (7777, 1, 1), (101, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert all(got[k]["toxic"] == (k % 3 == 0) for k in range(102, 150))
    assert len(toxicity.classify(odd, spark.read.parquet(f"{SF}/labels.parquet")).collect()) == odd.count()
    assert toxicity.classify(empty, labels).count() == 0
    assert not any(r["toxic"] for r in toxicity.classify(docs, labels.limit(0)).collect())


def test_licenses(spark, odd, empty):
    notice = licenses.TEMPLATES["mit-notice"]
    changed = notice.replace("free of charge", "at no charge").upper()
    got = licenses.scan(frame(spark, [(1, f"before {changed} after", "en"), (2, "the MIT of the license", "en"), (3, None, "en"), (4, "Released under the MIT License. " * 2, "en")])).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(1, "mit-notice"), (4, "mit")} and sum(r["doc_id"] == 4 for r in got) == 2
    first = next(r for r in got if r["doc_id"] == 1)
    assert 0.8 <= first["coverage"] < 1 and first["first_word"] == 1
    found = {r["doc_id"] for r in licenses.scan(odd).collect()}
    marks = re.compile("Licensed under the Apache License, Version|Released under the MIT License|Licensed under CC BY-NC 4.0|licensed under the GNU General Public License, version 3")
    assert found == {r["doc_id"] for r in odd.collect() if marks.search(r["text"] or "")}
    assert licenses.scan(empty).count() == 0


def test_repeated_and_shortened_licenses(spark):
    """Copies in a row inside a text, and templates with a word missing or words between."""
    notice, mit = licenses.TEMPLATES["mit-notice"], "Released under the MIT License. "
    rows = [(1, f"intro words {mit}{mit}more", "en"), (2, "it is Released under MIT License today", "en"), (3, "x Released now under y the z MIT w License", "en"),
            (4, f"a b {notice} {notice} {notice} c", "en"), (5, "the license was released under the bridge", "en"), (6, f"{mit * 5}end", "en"), (7, f"Released under MIT License. {mit}end", "en")]
    got = sorted((r["doc_id"], r["license"], r["first_word"], r["matched"]) for r in licenses.scan(frame(spark, rows)).collect())
    n = len(re.findall("[A-Za-z]+", notice))
    assert got == [(1, "mit", 2, 5), (1, "mit", 7, 5), (2, "mit", 2, 4), (3, "mit", 1, 5), *[(4, "mit-notice", 2 + k * n, n) for k in range(3)], *[(6, "mit", 5 * k, 5) for k in range(5)], (7, "mit", 0, 4), (7, "mit", 4, 5)]


def test_patience_alignment():
    assert licenses.longest_rising([3, 1, 4, 1, 5, 9, 2, 6]) == [1, 2, 4, 7] or len(licenses.longest_rising([3, 1, 4, 1, 5, 9, 2, 6])) == 4
    pairs = licenses.align(np.array([1, 2, 3, 4, 5]), np.array([9, 1, 2, 8, 4, 5]))
    assert pairs == [(0, 1), (1, 2), (3, 4), (4, 5)]


def test_pipeline_stages(spark, odd):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, columns = docs.count(), docs.columns
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and 0 < docs.count() <= before, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.where("rank = 1").count() == docs.count()

"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chat, exact_search, jaccard_join, key_exchange, language_id, language_model, mixing, one_bit_search, packing, runtime, substring_dedup, toxicity, vector_blocks, wordhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, key_id string"


def words(t):
    return WORD.findall((t or "").encode())


def documents(spark, seed=1, n=60):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdefé") for _ in range(rnd.randrange(1, 6))) for _ in range(300)]
    passage = " ".join(rnd.choice(pool) for _ in range(40))
    texts = []
    for i in range(n):
        t = [rnd.choice(pool) for _ in range(rnd.randrange(0, 200))]
        if i % 3 == 0:
            at = rnd.randrange(0, len(t) + 1)
            t[at:at] = passage.split()
        texts.append("\n".join(" ".join(t[k : k + 9]) for k in range(0, len(t), 9)))
    texts[7] = texts[3]
    texts[8] = texts[3] + " one more"
    texts[9] = texts[6].replace(" ", "\t ")
    texts += ["", None, "  \n", "short text", "short text", "x " * 5000, "ab" * 3000]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s1", "s2", None][i % 4], len(t or ""), i, str(i)) for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, 1, 0, ""), rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_dedup(rows, width=13):
    key = lambda r: runtime.LAST_ID if r.doc_id is None else r.doc_id
    first = {}
    for r in sorted(rows, key=key):
        w = words(r.text)
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), key(r))
    out = []
    for r in rows:
        w = words(r.text)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < key(r):
                gone[p : p + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((r.doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(docs, batches):
    got = substring_dedup.substring_dedup(docs, n_batches=batches).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_dedup(docs.collect())


def test_substring_dedup_keeps_columns_and_spacing(docs, empty):
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    by_id = {r.doc_id: r for r in kept.collect()}
    source = {r.doc_id: r for r in docs.collect()}
    assert by_id[0].text == source[0].text and by_id[0].key_id == "0"
    assert 7 not in by_id and by_id[61].text is None and by_id[60].text == ""
    assert substring_dedup.substring_dedup(empty).count() == 0


def thue_morse(n_doublings=11):
    bits = [0]
    for _ in range(n_doublings):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_modulo_powers_of_two(spark):
    a, b = thue_morse()
    twelve = [f"w{i}" for i in range(12)]
    df = spark.createDataFrame([(1, " ".join([*twelve, a])), (2, " ".join([*twelve, b])), (3, " ".join([*twelve, b]))], "doc_id long, text string")
    got = substring_dedup.substring_dedup(df, n_batches=2).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == brute_dedup(df.collect())
    rows = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    scored = {r.doc_id: r.n_known for r in language_model.deleted_interpolation(rows, F.col("doc_id") == 2).collect()}
    assert scored == {1: 2, 2: 1}


def test_hits_are_verified_on_words(docs, monkeypatch):
    """One chunk through all steps of the operator, with hashes under which many words fall together."""
    real = wordhash.Words.hashes
    monkeypatch.setattr(wordhash.Words, "hashes", lambda self, base=0: real(self, base) & np.uint64(1))
    rows = [r for r in docs.collect() if r.doc_id is not None and r.doc_id < 30 and r.text]
    rows = sorted({r.doc_id: r for r in rows}.values())
    ids = [r.doc_id for r in rows]
    table = pa.table({"text": [r.text for r in rows], "key_id": ids, "doc_id": ids, "row": ids})
    key, bits = (pa.scalar(0),), 3
    none = pa.table({"keys": pa.array([], pa.binary()), "first": pa.array([], pa.binary())})
    keys = substring_dedup._emit(13, bits, 5)(key, table)
    replies = [substring_dedup._merge_join(bits, False)((pa.scalar(b),), keys.filter(pc.equal(keys["bucket"], b)), none) for b in set(keys["bucket"].to_pylist())]
    replies = pa.concat_tables(replies).select(["bucket", "chunk", "keys", "first"])
    locate = substring_dedup._locate(13, bits, 5, False)
    want = {r[0]: r for r in brute_dedup(rows)}
    found = locate(key, table, replies)
    assert sum(found["n_removed"].to_pylist()) > sum(r[2] for r in want.values())
    spans = pa.Table.from_pylist([{"row_chunk": 0, "row": r["row"], **x} for r in found.to_pylist() for x in r["spans"]])
    bad = substring_dedup._verify(13)(key, spans, pa.table({"origin": ids, "text": table["text"]}))
    assert len(bad)
    found = locate(key, table, pa.concat_tables([replies, substring_dedup._refusals(key, bad)]))
    removed = dict(zip(ids, found["n_removed"].to_pylist()))
    assert all(removed[i] <= want[i][2] for i in ids) and sum(removed.values()) > 0
    spans = pa.Table.from_pylist([{"row_chunk": 0, "row": r["row"], **x} for r in found.to_pylist() for x in r["spans"]])
    assert not len(substring_dedup._verify(13)(key, spans, pa.table({"origin": ids, "text": table["text"]})))


def test_index_has_tiers_and_reopens(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FANOUT", 2)
    path = str(tmp_path / "index")
    index = substring_dedup.FingerprintIndex(spark, 1 << 20, path=path)
    parts = [docs.filter(f"doc_id >= {i} and doc_id < {i + 10}") for i in range(0, 60, 10)]
    for part in parts[:3]:
        index.add(part)
    assert sorted(t for t, _ in index.runs) == [0, 1]
    monkeypatch.setattr(substring_dedup, "BUCKET_KEYS", 1)
    again = substring_dedup.FingerprintIndex.open(spark, path)
    assert (sorted(again.runs), again.n_keys, again.base) == (sorted(index.runs), index.n_keys, index.base)
    bits = again.bits
    again.add(parts[3])  # splits the buckets
    assert again.bits > bits and [t for t, _ in again.runs] == [2]
    monkeypatch.setattr(substring_dedup, "BUCKET_KEYS", 1 << 20)
    got = again.add(parts[4], all_docs=docs).select("doc_id", "n_removed").collect()
    want = {r[0]: r[2] for r in brute_dedup(docs.filter("doc_id < 50").collect()) if r[0] >= 40}
    assert {r.doc_id: r.n_removed for r in got} == want
    again.drop()
    assert not (tmp_path / "index").exists()


def test_packed_integers():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        keys = np.sort(rnd.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True))
        assert (packing.unpack_sorted(packing.pack_sorted(keys)) == keys).all() and len(packing.unpack_sorted(packing.pack_sorted(keys))) == n
        ids = rnd.integers(-(2**63), 2**63 - 1, n) if n != 2 else np.array([5, 5])
        assert (packing.unpack_ids(packing.pack_ids(ids)) == ids).all()


def test_language_model(docs, empty):
    got = language_model.deleted_interpolation(docs, runtime.crc_mod("doc_id", 7) == 2).collect()
    rows = docs.collect()
    lower = lambda t: [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words(t)]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    count = collections.Counter()
    for r in rows:
        if not held(r.doc_id):
            count.update([*lower(r.text), None])
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for r in rows:
        t = [*lower(r.text), None]
        want[(r.doc_id, held(r.doc_id), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in t), 6))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.deleted_interpolation(empty, runtime.crc_mod("doc_id", 7) == 2).count() == 0


def brute_interpolation(spark, docs, held, folds, steps):
    """Deleted interpolation of bigrams, token by token. held: of a doc_id; the chunk of a row as the operator deals it."""
    total = key_exchange.total_bytes(docs)
    n_chunks = max(key_exchange.sizes(total)[0], 8 * folds)
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).alias("chunk")).collect()
    lower = lambda t: [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words(t)]
    one, two, rest_one, rest_two, deleted = (collections.Counter() for _ in range(4)), None, None, None, []
    one, two, rest_one, rest_two = one
    for r in rows:
        tokens = [*lower(r.text), None]
        pairs = list(zip([None, *tokens[:-1]], tokens, strict=True))
        if not held(r.doc_id):
            one.update(tokens)
            two.update(pairs)
            if r.chunk % folds:
                rest_one.update(tokens)
                rest_two.update(pairs)
            else:
                deleted += pairs
    v = len(one)

    def estimates(pair, ones, twos):
        n = sum(ones.values())
        c = ones[pair[0]]
        return [1 / (v + 1), ones[pair[1]] / max(n, 1), twos[pair] / c if c else 0.0], math.frexp(c)[1] if c else 0

    def binned(f):
        return [f[0]] + [2.0 ** (-(1 + math.floor(-steps * math.log2(x)) - 0.5) / steps) if x else 0.0 for x in f[1:]]

    seen = collections.Counter()
    for pair in deleted:
        f, bucket = estimates(pair, rest_one, rest_two)
        seen[bucket, tuple(binned(f))] += 1
    if not seen:
        shared = [1 / 3] * 3
        weights = collections.defaultdict(lambda: shared)
    else:
        shared = [1 / 3] * 3
        for _ in range(50):
            new = [0.0] * 3
            for (_, f), n in seen.items():
                p = [a * b for a, b in zip(shared, f, strict=True)]
                new = [a + n * b / sum(p) for a, b in zip(new, p, strict=True)]
            shared = [x / sum(new) for x in new]
        floor = [max(x, 1e-9) for x in shared]
        shared = [x / sum(floor) for x in floor]
        weights = {b: shared for b in range(65)}
        for _ in range(50):
            sums = {b: list(shared) for b in range(65)}
            for (b, f), n in seen.items():
                p = [x * y for x, y in zip(weights[b], f, strict=True)]
                sums[b] = [s + n * x / sum(p) for s, x in zip(sums[b], p, strict=True)]
            weights = {b: [x / sum(s) for x in s] for b, s in sums.items()}
        weights[0] = [x / sum(weights[0][:2]) for x in weights[0][:2]] + [0.0]
    out = collections.Counter()
    for r in rows:
        tokens = [*lower(r.text), None]
        score = 0.0
        for pair in zip([None, *tokens[:-1]], tokens, strict=True):
            f, bucket = estimates(pair, one, two)
            score += math.log10(sum(x * y for x, y in zip(weights[bucket], f, strict=True)))
        out[r.doc_id, round(score, 5)] += 1
    return out


def test_language_model_score(spark, docs):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    got = language_model.deleted_interpolation(docs, runtime.crc_mod("doc_id", 7) == 2).collect()
    want = brute_interpolation(spark, docs, held, language_model.FOLDS, language_model.STEPS)
    assert collections.Counter((r.doc_id, round(r.score, 5)) for r in got) == want
    # words in an order that training has are likelier than the same words turned round
    seen = docs.filter("doc_id in (0, 3, 6, 12)").select("text").collect()
    turned = spark.createDataFrame([(10_000 + i, t) for i, r in enumerate(seen) for t in (" ".join(r.text.split()[::-1]),)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in language_model.deleted_interpolation(docs.select("doc_id", "text").union(turned), F.col("doc_id") >= 10_000).collect()}
    assert all(scores[i] > scores[10_000 + k] for k, i in enumerate((0, 3, 6, 12)))


def test_interpolation_weights_are_a_distribution():
    w = language_model.learn_weights(np.array([[1, 8, 8, 100], [3, 20, 4, 50], [0, 30, 0, 10]]), 2, 1000)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[0, 2] == 0 and w[3, 2] > w[3, 1]


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    rows = docs.collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, rest = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        all_w = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / all_w > 2 * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / all_w for s in left}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left.discard(s)
            rest -= target[s]
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r.taken == r.copies * r.size <= 2 * r.size and r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(len(words(r.text)) for r in rows if r.source == s)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((repr(r.doc_id), r.taken) for r in again) == sorted((repr(r.doc_id), r.taken) for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0


def brute_jaccard(rows, threshold=0.8):
    sets = {}
    for r in rows:
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(r.text)]
        if r.doc_id is not None and w:
            sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_jaccard_join(spark, docs, empty):
    rows = docs.collect()
    want = brute_jaccard(rows)
    got = jaccard_join.jaccard_join(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.class_id == want.get(r.doc_id, r.doc_id)
    assert {r.doc_id: r.n_links for r in got}[60] == 0
    kept = jaccard_join.first_of_each_class(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({*want.values(), 60, 61, 62})
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_jaccard_join_large_groups(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    common = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(120):  # near copies of one text
        t = list(base)
        for _ in range(rnd.randrange(0, 3)):
            t[rnd.randrange(len(t))] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    for i in range(120, 240):  # one passage in texts that are otherwise of their own
        rows.append((i, " ".join(common + [f"u{rnd.randrange(10**6)}" for _ in range(60)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in jaccard_join.jaccard_join(df).collect()}
    assert got == brute_jaccard(df.collect())

def brute_links(rows, threshold=0.8):
    sets = {}
    for r in rows:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    return {a: sum(a != b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) for b in sets) for a in sets}


def bridged_copies(n, seed, length=300):
    """n copies of each of two texts that are not similar, and two texts between them that alone link the two."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(length)]
    steps = [(10 + 20 * k, f"v{rnd.randrange(10**6)}") for k in range(10)]
    texts = []
    for n_steps, many in ((0, n), (10, n), (3, 1), (7, 1)):
        for i in range(many):
            t = list(base)
            for at, word in steps[:n_steps]:
                t[at] = word
            if many > 1:
                t[220 + rnd.randrange(70)] = f"e{rnd.randrange(10**6)}"
            texts.append(" ".join(t))
    return texts


@pytest.fixture(scope="module")
def near_copies(spark):
    texts = [t for s in range(4) for t in bridged_copies(40, s)]
    rnd = random.Random(7)
    return spark.createDataFrame(rnd.sample(list(enumerate(texts)), len(texts)), "doc_id long, text string").cache()


def test_jaccard_join_classes_of_near_copies(spark, near_copies, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 1 << 14)  # several blocks
    got = {r.doc_id: r.class_id for r in jaccard_join.jaccard_join(near_copies).collect()}
    assert got == brute_jaccard(near_copies.collect())


def test_jaccard_join_compares_blocks_exactly(monkeypatch):
    rnd = np.random.default_rng(1)
    xs, ys = ([np.sort(rnd.choice(np.r_[np.arange(40), np.arange(1000, 1400)], 60, replace=False)).astype(np.uint64) for _ in range(n)] for n in (30, 50))
    want = [[len(np.intersect1d(a, b)) for b in ys] for a in xs]
    for dense in (0.0, 0.01, 0.1, 2.0):
        monkeypatch.setattr(jaccard_join, "DENSE", dense)
        assert (jaccard_join._in_common(xs, ys) == want).all()


def test_jaccard_join_no_cap_on_buckets(spark):
    rows = [(path, rep, 100, 5, 5, 5, 5) for path in range(8) for rep in range(40)]
    large = spark.createDataFrame(rows, "path long, rep long, size int, s0 long, s1 long, s2 long, s3 long")
    got = {(r.path, r.rep) for r in jaccard_join._near_copies(large, 0.8).collect()}
    assert got == {r[:2] for r in rows}


def test_jaccard_join_n_links_of_near_copies(spark, near_copies, monkeypatch):
    for tokens in (jaccard_join.BLOCK_TOKENS, 1 << 14):
        monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", tokens)
        got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(near_copies).collect()}
        assert got == brute_links(near_copies.collect())


def test_jaccard_join_recall_of_deep_levels(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "NEAR_COPIES", 9)  # all buckets split, to the last level
    n, n_runs, levels = 4000, jaccard_join.runs_for(0.8), jaccard_join.LEVELS
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):  # the choices that two sets at the threshold have in common
        chosen = [rng.integers(0, 2**31 - 1, k).tolist() for k in rng.binomial(800, 2 / 900, n_runs * levels)]
        rows += [(2 * i + k, 900, 0, 0, 0, 0, chosen) for k in (0, 1)]
    reps = spark.createDataFrame(rows, jaccard_join.SIGNATURES.replace("doc_id", "rep").replace("hi long, lo long, ", ""))
    pairs, left = jaccard_join.candidates(reps, n_runs, small=1)
    together = collections.defaultdict(set)
    for r in left.collect():
        together[r.path].add(r.rep)
    met = {(r.a, r.b) for r in pairs.collect()} | {(i, i + 1) for reps in together.values() for i in reps if i % 2 == 0 and i + 1 in reps}
    assert met >= {(2 * i, 2 * i + 1) for i in range(n)}


VECTORS = "vec_id long, embedding array<double>, label int, block string, shelf int"


def vectors(spark, n=400, dim=16):
    rnd = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rnd.normal(size=dim)], 1, "", 1) for i in range(n)]
    rows += [(n + i, rows[3][1], 1, "", 1) for i in range(30)]
    rows += [(900, None, 1, "", 1), (901, [None] * dim, 1, "", 1), (902, [math.nan] * dim, 1, "", 1), (903, [math.inf] * dim, 1, "", 1), (920, [0.0] * dim, 1, "", 1), (None, rows[0][1], 1, "", 1), (904, [], 1, "", 1), rows[20]]
    return spark.createDataFrame(rows, VECTORS)


@pytest.mark.parametrize("exact", [True, False])
def test_searches(spark, exact):
    df = vectors(spark)
    f = exact_search.exact_top_k if exact else one_bit_search.approximate_top_k
    got = collections.defaultdict(list)
    for r in f(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = {}
    for r in df.collect():
        e = r.embedding
        if r.vec_id is not None and e and all(v is not None and math.isfinite(v) for v in e) and (exact or any(e)):
            x[r.vec_id] = [math.floor(64 * v) for v in e] if exact else e
    hit = total = 0
    assert sorted(got) == sorted(i for i in x if i % 20 == 0)
    for q, found in got.items():
        scores = {i: sum(a * b for a, b in zip(x[q], x[i])) for i in x if i != q}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        assert all(s == pytest.approx(scores[i], abs=1e-9) for i, s in found) and len(found) == 20
        assert [i for i, _ in found] == sorted((i for i, _ in found), key=lambda i: (-round(scores[i], 9), i))
        if exact:
            assert [i for i, _ in found] == best
        hit, total = hit + len({i for i, _ in found} & set(best)), total + 20
    assert hit >= 0.9 * total
    few = df.filter("vec_id < 3 or vec_id is null")
    assert f(few, F.col("vec_id") == 0).count() == 2
    assert f(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("away", [1, 10, 1e3, 1e6])
def test_exact_search_bounds_hold_with_a_pivot_far_away(away):
    rnd = np.random.default_rng(3)
    for dim in (2, 16):
        x = np.floor(64 * rnd.normal(size=(3000, dim)))
        x[7] *= away
        ids = np.arange(len(x))
        search = exact_search.pivot_search(np.concatenate([x[7:8], x[20:25]]), 20)(x, ids)
        at, of, score = search(x[::50], ids[::50])
        for i, q in enumerate(ids[::50].tolist()):
            all_scores = x @ x[q]
            best = sorted((j for j in range(len(x)) if j != q), key=lambda j: (-all_scores[j], j))[:20]
            assert of[at == i].tolist() == best and score[at == i].tolist() == all_scores[best].tolist()
        if away == 1 and dim == 2:
            assert search.evaluated < 0.5 * 60 * 3000  # most are never evaluated


@pytest.mark.parametrize("exact", [True, False])
def test_searches_with_several_dimensions_and_shelves(spark, exact, monkeypatch):
    monkeypatch.setattr(vector_blocks, "LEAST", 40)
    rnd = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rnd.normal(size=3 + i % 2)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    f = exact_search.exact_top_k if exact else one_bit_search.approximate_top_k
    got = f(df, F.col("vec_id") % 20 < 2, k=5).collect()
    assert len(got) == 20 * 5 and {(r.query_id - r.vec_id) % 2 for r in got} == {0}
    assert not {r.query_id for r in got if r.query_id == r.vec_id}


def test_byte_bpe(docs, empty):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.ByteBpe.load(path)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    ours = byte_bpe.TextCoder(bpe, P.PATTERN)
    rnd = random.Random(2)
    pool = [chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0, 0x3000), rnd.randrange(0x10000, 0x20000)])) for _ in range(300)] + list("aaeett  \n\x1c")
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(120))) for _ in range(150)] + ["a" * 3001, "!?" * 800, " " * 2000, "", "".join(rnd.choice("etaoinshr") for _ in range(30000))]
    for t in texts:
        ids, _, written = ours.encode([t])
        assert ids.tolist() == theirs.encode_ordinary(t) and written[0] == ",".join(map(str, ids.tolist())) and bpe.decode(ids).tobytes() == t.encode()
    got = byte_bpe.encode_and_decode(docs, path, P.PATTERN, with_ids=True).collect()
    want = sorted((repr(r.doc_id), len(e := theirs.encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert byte_bpe.encode_and_decode(empty, path, P.PATTERN).count() == 0


def test_toxicity(spark):
    rnd = random.Random(4)
    pool = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        bad = rnd.random() < 0.2
        t = [rnd.choice(pool) for _ in range(30)] + ([rnd.choice(["stuppid", "worthlezz"])] if bad else [])
        rnd.shuffle(t)
        rows.append((i, " ".join(t), "x"))
        labels.append((i, int(bad), "y"))
    rows += [(600, None, ""), (601, "", ""), (None, "a b", ""), rows[0]]
    labels += [(5, None, ""), (None, 1, ""), (9999, 1, ""), (6, 7, "")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = toxicity.score_toxicity(docs, lab, runtime.crc_mod("doc_id", 4) == 2).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: y for i, y, _ in labels[:600]}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    changed = lab.withColumn("toxic", F.when(runtime.crc_mod("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score_toxicity(docs, changed, runtime.crc_mod("doc_id", 4) == 2).collect()
    assert sorted((repr(r.doc_id), round(r.score, 9)) for r in again) == sorted((repr(r.doc_id), round(r.score, 9)) for r in got)
    assert toxicity.score_toxicity(docs.limit(0), lab, runtime.crc_mod("doc_id", 4) == 2).count() == 0


def test_toxicity_against_plain_python():
    """Counts, ratios, the fitted loss and scores of a few texts, without numpy's vectors."""
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcd ") for _ in range(rnd.randrange(0, 60))) + (" zork" if i % 3 == 0 else "") for i in range(60)] + ["", "é" * 9]
    toxic = [int(i % 3 == 0) for i in range(60)] + [0, 0]

    def hashed(text):
        out = set()
        for n in toxicity.ORDERS:
            for at in range(len(text) - n + 1):
                h = 0
                for c in text[at : at + n]:
                    h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
                out.add(int(wordhash.mix(np.array([h ^ (n << 56) % 2**64], np.uint64))[0] >> np.uint64(64 - toxicity.BITS)))
        return out

    sets = [hashed(t.lower()) for t in texts]
    doc, gram = toxicity.present(texts)
    assert [set(gram[doc == i].tolist()) for i in range(len(texts))] == sets
    counts = np.zeros((2, 1 << toxicity.BITS), np.int64)
    for s, y in zip(sets, toxic, strict=True):
        for g in s:
            counts[y, g] += 1
    rows = np.array([toxic.count(0), toxic.count(1)])
    lookup, ratio = toxicity.select(counts, rows, 200)
    for g in np.flatnonzero(lookup >= 0).tolist():
        want = math.log((counts[1, g] + 1) / (rows[1] + 2)) - math.log((counts[0, g] + 1) / (rows[0] + 2))
        assert ratio[lookup[g]] == pytest.approx(want)
    doc, feature = toxicity.present(texts, lookup)
    weight, bias = toxicity.fit(doc, feature, np.array(toxic, float), ratio)

    def loss(w, b):
        out = toxicity.PENALTY / 2 * sum(x * x for x in w)
        for s, y in zip(sets, toxic, strict=True):
            z = b + sum(w[lookup[g]] * ratio[lookup[g]] for g in s if lookup[g] >= 0)
            out += (math.log1p(math.exp(-abs(z))) + max(z, 0) - y * z) / len(toxic)
        return out

    best = loss(weight, bias)
    for _ in range(20):  # no step from the solution is better by more than a little
        assert loss(weight + np.array([rnd.gauss(0, 0.05) for _ in weight]), bias + rnd.gauss(0, 0.05)) > best - 1e-3
    scores = toxicity.Model(lookup, weight * ratio, bias).score(texts)
    for s, p in zip(sets, scores, strict=True):
        assert p == pytest.approx(1 / (1 + math.exp(-(bias + sum(weight[lookup[g]] * ratio[lookup[g]] for g in s if lookup[g] >= 0)))))


def brute_language_id(rows, names):
    """Posterior of each language for each row: (text, declared, host), all evidence by loops."""
    mod = 1 << language_id.BITS

    def slots(text):
        low = (text or "").lower()
        out = []
        for at in range(len(low) - 2):
            h = 0
            for c in low[at : at + 3]:
                h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
            out.append(int(wordhash.mix(np.array([h ^ (3 << 56)], np.uint64))[0] >> np.uint64(64 - toxicity.BITS)) >> language_id.SHIFT)
        return out

    cut = [slots(t) for t, _, _ in rows]
    counts = {k: collections.Counter() for k in names}
    for s, (_, declared, _) in zip(cut, rows, strict=True):
        if declared in counts:
            counts[declared].update(s)
    sums = {k: sum(c.values()) + 0.05 * mod for k, c in counts.items()}
    soft = lambda x: [math.exp(a - max(x)) / sum(math.exp(b - max(x)) for b in x) for a in x]
    logs, posts = [], []
    for s in cut:
        mean = [sum(math.log((counts[k][g] + 0.05) / sums[k]) for g in s) / max(len(s), 1) for k in names]
        logs.append([x * min(len(s), language_id.EFFECTIVE) for x in mean])
        posts.append(soft(logs[-1]))
    spoke = [i for i, s in enumerate(cut) if s]
    mass = [sum(posts[i][j] for i in spoke) for j in range(len(names))]
    prior = [(m + 1) / (sum(mass) + len(names)) for m in mass]
    out = []
    for i, (_, declared, host) in enumerate(rows):
        total = list(logs[i])
        on_host = [sum(posts[x][j] for x in spoke if rows[x][2] == host and host is not None) for j in range(len(names))]
        for j in range(len(names)):
            total[j] += math.log((on_host[j] + language_id.KAPPA * prior[j]) / (sum(on_host) + language_id.KAPPA))
        if declared is not None and any(rows[x][1] == declared for x in spoke):
            of = [sum(posts[x][j] for x in spoke if rows[x][1] == declared) for j in range(len(names))]
            share = max(sum(of) / max(sum(mass), 1), 1e-9)
            for j in range(len(names)):
                total[j] += math.log((of[j] + language_id.KAPPA * share) / (mass[j] + language_id.KAPPA))
        out.append(soft(total))
    return out


def test_language_id_against_brute_force(spark):
    rnd = random.Random(9)
    syllables = {"en": ["th", "ing", "er", "and"], "de": ["sch", "ung", "er", "ing"], "fr": ["eau", "que", "er", "and"]}
    rows = []
    for i in range(90):
        lang = ["en", "de", "fr"][i % 3]
        text = " ".join("".join(rnd.choice(syllables[lang]) for _ in range(2)) for _ in range(rnd.randrange(0, 8)))
        rows.append((text, [lang, lang, None, "de"][rnd.randrange(4)], [None, "h1", "h2"][rnd.randrange(3)]))
    rows += [(None, "en", "h1"), ("", None, None), ("x" * 20000, "fr", None)]
    df = spark.createDataFrame([(i, *r, "extra") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, posterior string")
    got = {r.doc_id: r for r in language_id.identify(language_id.document_evidence(df), "doc_id").collect()}
    names = ["de", "en", "fr"]
    for i, p in enumerate(brute_language_id(rows, names)):
        assert got[i].posterior == pytest.approx(max(p), abs=1e-9) and (got[i].lang_id == names[p.index(max(p))] or sorted(p)[-1] - sorted(p)[-2] < 1e-9)


def test_language_id_takes_rare_languages_at_their_word(spark):
    rows = [(i, f"the thing and the other one number {i}", "en", "h") for i in range(20)] + [(20, "kaj la alia afero", "eo", "h"), (21, "", "xx", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.lang_id, r.posterior, r.accepted) for r in language_id.identify(language_id.document_evidence(df), "doc_id").filter("doc_id >= 20").collect()}
    assert got == {20: ("eo", None, True), 21: ("xx", None, False)}
    assert 20 in {r.doc_id for r in language_id.accepted_documents(df).collect()}


def test_stages_with_clashing_and_dotted_columns(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "_id", "__id", "chunk", "kept_text", "row", "copies", "in_text"]
    rows = [(i, f"some words of text number {i % 4} " * 9, "en", "s", 5, i, 1, 2, 3, "k", 4, 5, "t") for i in range(12)] + [(0, "some words of text number 0 " * 9, "en", "s", 5, 0, 1, 2, 3, "k", 4, 5, "t")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` long, _id int, __id int, chunk int, kept_text string, `row` int, copies int, in_text string")
    assert docs.columns == names
    for stage in (language_id.accepted_documents, jaccard_join.first_of_each_class, substring_dedup.without_repeats, mixing.mixed_documents):
        out = stage(docs)
        assert out.columns == names and out.dtypes == docs.dtypes
        assert all(r[5] == r.doc_id and r[6:] == (1, 2, 3, "k", 4, 5, "t") for r in out.collect())
    taken = mixing.mix(docs).filter("doc_id = 0").collect()
    assert len(taken) == 4 and max(r.copies for r in taken) - min(r.copies for r in taken) <= 1


def test_language_id(spark):
    rnd = random.Random(6)
    syllables = {"en": ["th", "ing", "er", "and"], "de": ["sch", "ung", "ei", "zu"], "fr": ["eau", "que", "ment", "oi"]}
    rows = []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        text = " ".join("".join(rnd.choice(syllables[lang]) for _ in range(3)) for _ in range(40))
        rows.append((i, text, lang if i % 10 else None, f"h{lang}", 1))
    rows += [(240, None, "en", "hen", 1), (241, "", None, None, 1), (242, "zzzz qqqq xxxx 0000 @@@@ " * 9, "en", "hen", 1), (None, rows[0][1], "en-GB", "hen", 1), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_grams int")
    got = language_id.identify(language_id.document_evidence(docs), "doc_id").collect()
    assert len(got) == len(rows)
    assert all(r.lang_id == ["en", "de", "fr"][r.doc_id % 3] and r.accepted for r in got if r.doc_id is not None and r.doc_id < 240)
    by_id = {r.doc_id: r for r in got}
    assert not by_id[240].accepted and by_id[240].lang_id == "en" and not by_id[241].accepted
    kept = language_id.accepted_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(240))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://a.b.example."), F.coalesce("lang", F.lit("com")), F.lit("/x")).alias("url"), F.concat(F.lit('<html lang="'), F.coalesce("lang", F.lit("")), F.lit('"><script>x</script><p>'), F.coalesce("text", F.lit("")), F.lit("</p>")).alias("html"))
    evidence = language_id.page_evidence(pages)
    row = evidence.filter("page_id = 1").first()
    assert (row.declared, row.suffix, row.domain, row.host) == ("de", "de", "example.de", "a.b.example.de")
    assert all(r.lang_id == ["en", "de", "fr"][r.page_id % 3] for r in language_id.identify(evidence, "page_id").collect() if r.page_id is not None and r.page_id < 240)
    assert language_id.identify(language_id.document_evidence(docs.limit(0)), "doc_id").count() == 0


CHAT = "conv_id long, turn long, role string, text string, position int, `a.b` int"


def test_chat(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are   you?", 0, 0),
        (1, 1, "assistant", "On Monday X wrote:\n> hello there\n> How are you?\nFine thanks.\n\nAnd you?", 0, 0),
        (1, 2, "user", ">> Hello there\n>> how are you?\n> Fine thanks.\n>\n> And you?\nGood > bad", 0, 0),
        (1, 3, "user", "> Hello there\nre the first", 0, 0),
        (1, 4, "user", "> never said\nx", 0, 0),
        (2, 0, "user", None, 0, 0),
        (2, 1, "a", "", 0, 0),
        (None, None, "u", "q", 0, 0),
        (1, 0, "user", "Hello there\nHow are   you?", 0, 0),
    ]
    df = spark.createDataFrame(rows, CHAT)
    formatted = chat.format_conversations(df)
    got = {(r.conv_id, r.turn): (r.message, r.reply_to, r.depth, r.position, r.linked, r.n_quoted, r.text) for r in formatted.collect()}
    assert got == {
        (1, 0): (0, None, 0, 0, False, 0, "Hello there\nHow are   you?"),
        (1, 1): (1, 0, 1, 1, True, 2, "Fine thanks.\n\nAnd you?"),
        (1, 2): (2, 1, 2, 2, True, 5, "Good > bad"),
        (1, 3): (3, 0, 1, 3, True, 1, "re the first"),
        (1, 4): (4, 3, 2, 4, False, 1, "x"),
        (2, 0): (0, None, 0, 0, False, 0, ""),
        (2, 1): (1, 0, 1, 1, False, 0, ""),
        (None, None): (0, None, 0, 0, False, 0, "q"),
    }
    whole = {(r.conv_id, r.part): [m.message for m in r.messages] for r in chat.assembled(formatted, 3).collect()}
    assert whole == {(1, 0): [0, 1, 2], (1, 1): [3, 4], (2, 0): [0, 1], (None, 0): [0]}
    assert chat.format_conversations(df.limit(0)).count() == 0


def brute_chat(rows, ties):
    """Numbers, parents and reply order of messages that quote whole single lines."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted({r for r in rows if r[0] == conv}, key=lambda r: (r[1] is None, r[1] or 0, ties[r[2], r[3]]))
        said = [[x for x in r[3].split("\n") if not x.startswith(">")] for r in own]
        parent = []
        for n, r in enumerate(own):
            quoted = [x[1:].strip().lower() for x in r[3].split("\n") if x.startswith(">")]
            at = [m for m in range(n) if quoted and quoted[0] in [x.lower() for x in said[m]]]
            parent.append(at[-1] if at else n - 1 if n else None)
        children = collections.defaultdict(list)
        for n, p in enumerate(parent):
            children[p].append(n)
        place, stack = [], [(n, 0) for n in reversed(children[None])]
        while stack:
            n, depth = stack.pop()
            place.append(n)
            out[own[n]] = (n, parent[n], depth, len(place) - 1)
            stack += [(c, depth + 1) for c in reversed(children[n])]
    return out


def test_chat_reply_order(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH_BITS", 3)
    rnd = random.Random(6)
    rows = []
    for conv, size in ((1, 150), (2, 40), (None, 30), (3, 1)):
        for i in range(size):
            text = f"words of {conv} {i}"
            if i and rnd.random() < 0.4:
                text = f"> Words of {conv} {rnd.randrange(max(0, i - 20), i)}\n" + text
            rows.append((conv, None if conv == 2 and i > 20 else i // 3 if conv is None else 7 if conv == 2 and i > 10 else i, "u", text))
    rows += rows[5:9]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ties = {(r.role, r.text): r.t for r in df.select("role", "text", F.xxhash64("role", "text").alias("t")).collect()}
    want = brute_chat(rows, ties)
    got = {(r.conv_id, r.turn, r.role, raw.text): (r.message, r.reply_to, r.depth, r.position) for r, raw in _with_raw(chat.format_conversations(df), df)}
    assert got == want


def _with_raw(formatted, df):
    by_text = {r.text.split("\n")[-1]: r for r in df.collect()}
    return [(r, by_text[r.text]) for r in formatted.collect()]


def test_chat_links_across_stretches(spark):
    rows = [(7, 0, "user", "the first words of all")] + [(7, i, "user", f"filler {i}") for i in range(1, 700)] + [(7, 700, "a", "> The  first words of ALL\nyes")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = got.filter("turn = 700").first()
    assert (r.reply_to, r.linked, r.depth, r.position, r.text) == (0, True, 1, 700, "yes")
    assert got.filter("turn = 256").first().reply_to == 255


def test_chat_very_long_message(spark):
    long = "\n".join(f"line {i} of a long message" for i in range(20000))
    rows = [(1, 0, "u", long), (1, 1, "u", "between"), (1, 2, "u", "> " + long.replace("\n", "\n> ") + "\nseen")]
    got = {r.turn: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[2].reply_to, got[2].n_quoted, got[2].text) == (0, 20000, "seen") and got[0].text == long


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    P = pytest.importorskip("public_tokenizers")
    sf = str(tmp_path)
    documents(spark, seed=9).select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id is not null").write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        after = spark.read.parquet(f"{sf}/{name}")
        if i < 4:
            assert after.columns == start.columns
        if name == "jaccard_join":
            want = brute_jaccard(docs.collect())
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect() if want.get(r.doc_id, r.doc_id) == r.doc_id}
        if name == "substring_dedup":
            removed = {r[0]: r[2] for r in brute_dedup(docs.collect())}
            left = {r.doc_id: len(words(r.text)) for r in after.collect()}
            assert all(left.get(r.doc_id, 0) == len(words(r.text)) - removed[r.doc_id] for r in docs.collect())
        docs = after
    bpe = byte_bpe.ByteBpe.load(P.path(corpus_pipeline.VOCABULARY))
    mixed = spark.read.parquet(f"{sf}/mixing").collect()
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in mixed)
    texts = {r.doc_id: r.text or "" for r in mixed}
    assert all(bpe.decode(np.array(r.ids, dtype=np.int64)).tobytes().decode() == texts[r.doc_id] for r in docs.collect())
    assert corpus_pipeline.run(spark, sf).count() == docs.count()

"""Conversation repair, token alignment and quality rules against brute force, with their edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair, quality, token_alignment

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"


# --- conversation repair


def cheapest(rows):
    """(cost, audit) over a plain machine of four states: 0 begin, 1 after system, 2 after user, 3 after assistant."""

    def with_inserts(at):
        for _ in range(3):
            for st, (cost, audit) in list(at.items()):
                to = 3 if st == 2 else 2
                at[to] = min(at.get(to, (cost + 3, audit + "I")), (cost + 3, audit + "I"))
        return at

    at = with_inserts({0: (0, "")})
    for initial, sound, cut in rows:
        into = {}
        for st, (cost, audit) in at.items():
            ways = [(st, cost + 4, "D")]
            to = 3 if st == 2 else 2
            if sound:
                ways.append((to, cost + 3 + 3 * cut, "R"))
                if initial == "s" and st == 0:
                    ways.append((1, cost + 3 * cut, "K"))
                if initial == "ua"[to - 2]:
                    ways.append((to, cost + 3 * cut, "K"))
            for st2, c, e in ways:
                into[st2] = min(into.get(st2, (c, audit + e)), (c, audit + e))
        at = with_inserts(into)
    return min(v for st, v in at.items() if st in (0, 3))


def brute_repair(rows):
    out = {}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, parsed = set(), collections.Counter(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            parsed.append((role[:1], fault in ("", "truncated"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(parsed)
        n, lines, i = len(audit) - audit.count("D"), [], 0
        for e in audit:
            k = len(lines) - n % 2
            name = "user" if k % 2 == 0 else "assistant"
            if e == "I":
                lines.append(f"{name}:")
                continue
            if e != "D":
                lines.append(f"{own[i][1] if e == 'K' else name}:{own[i][2]}")
            i += 1
        out[c] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def turns(rnd, c, n):
    texts = ["A.", "B!", "cut", "", " \n", None, "Dé?", "x. "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]
    return [(c, rnd.choice([None, *range(n)]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"t{rnd.randrange(999)}.") for _ in range(n)]


def test_repair_of_random_conversations(spark):
    rnd = random.Random(2)
    rows = [r for c in range(300) for r in turns(rnd, c, rnd.randrange(1, 9))] + turns(rnd, None, 9)
    rows += [rows[0], rows[0], (500, 1, "user", "one."), (500, 1, "user", "one.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", audit string")
    got = {r.conv_id: tuple(r[c] for c in COUNTS) for r in conversation_repair.repair(df).collect()}
    assert got == brute_repair(rows)
    assert conversation_repair.repair(df.limit(0)).collect() == []


def test_repair_of_a_conversation_that_many_tasks_share(spark):
    """A third of all rows in one conversation, in blocks and parts; a thousand equal rows; very long texts."""
    rnd = random.Random(3)
    hot = [(7, t, rnd.choice(["user", "assistant", "assistant", "system"]), f"m{rnd.randrange(3000)}{rnd.choice(['.', '', '!'])}") for t in range(6000)]
    rows = [r for c in range(100, 1200) for r in turns(rnd, c, rnd.randrange(1, 9))] + hot
    rows += [(8, 3, "user", "again.")] * 1000 + [(8, 4, "assistant", "so."), (9, 0, "user", "long " * 400_000 + "."), (9, 1, "assistant", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, TURNS).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.conv_id: tuple(r[c] for c in COUNTS) for r in conversation_repair.repair(df).collect()}
        parts = conversation_repair._parsed(df).filter("conv_id = 7").groupBy("kind").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_repair(rows)
    assert {r["kind"]: r["count"] > 1 for r in parts} == {"part": True, "block": True}
    messages = sorted(conversation_repair.repaired_messages(df).filter("conv_id = 7").collect())
    assert [m.position for m in messages] == list(range(len(messages)))
    assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in messages).encode()).hexdigest() == got[7][-1]


def test_damage(spark):
    rows = [(c, t, "assistant", "Yes. No!") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    out = collections.defaultdict(list)
    for r in conversation_repair.damaged(spark.createDataFrame(rows, TURNS)).collect():
        out[r.conv_id, r.turn].append((r.role, r.text))
    import zlib

    faults = {0: [], 1: [("assistant", "")], 2: [("assistant", "Yes No")], 3: [("assistant", "Yes. No!")] * 2, 4: [("user", "Yes. No!")]}
    for c, t, _, _ in rows[:-1]:
        assert out.get((c, t), []) == faults.get(zlib.crc32(f"{c}:{t}".encode()) % 20, [("assistant", "Yes. No!")])


def test_chart_items():
    assert sorted(conversation_repair.START) == [("D", ""), ("T", "sua"), ("T", "ua")]
    assert conversation_repair.ITEMS == [("D", ""), ("T", ""), ("T", "a"), ("T", "sua"), ("T", "ua")]


# --- token alignment


@pytest.fixture(scope="module")
def paths():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(texts, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a_coder, b_coder = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a_coder.encode_special_tokens = True
    of = token_alignment.byte_level()
    rows, counts = [], collections.Counter()
    for text in texts:
        raw = f" {text}".encode()
        a = a_coder.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        a_raw = [bytes(of[c] for c in a_coder.id_to_token(i)) for i in a]
        b_raw = [bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_raw) != raw or b"".join(b_raw) != raw:
            rows.append(None)
            continue
        owner = [[k for k, x in enumerate(parts) for _ in x] for parts in (a_raw, b_raw)]
        pairs = [(a[i], b[j]) for i, j in sorted(set(zip(*owner)))]
        cuts = [k for k in range(1, len(raw) + 1) if k == len(raw) or owner[0][k] != owner[0][k - 1] and owner[1][k] != owner[1][k - 1]]
        shown = [[",".join(str(ids[i]) for i in sorted(set(own[s:e]))) for ids, own in ((a, owner[0]), (b, owner[1]))] for s, e in zip([0, *cuts], cuts)]
        rows.append((len(a), len(b), len(cuts), pairs, ";".join("|".join(x) for x in shown)))
        counts.update(pairs)
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(*r[:3], len(r[3]), sum(counts[p] == best[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), hashlib.sha256(r[4].encode()).hexdigest()) if r else (0, 0, 0, 0, 0, 0, "") for r in rows]


def test_alignment(spark, paths):
    rnd = random.Random(5)
    letters, parts = "ab c\n\n  \t.'é漢▁<>|x1 \r\x1c ", ["the", "don't", "<|endoftext|>", "<s>", "x\ny", "\n", "", "  z", "日本", "1234", "###", "́e", "naïve"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(250)]
    texts += [" ".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(250)]
    texts += [None, "", " ", "\n", "same", "same", "▁", "ab" * 3000, "one two " * 5000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "same", "x"), (4, texts[4], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string")
    got = [tuple(r) for r in token_alignment.align(df, *paths).collect()]
    want = [(r[0], *x) for r, x in zip(rows, brute_alignment([r[1] for r in rows], paths))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(x[-1] == "" for x in want) > 20
    shown = token_alignment.align(df, *paths, with_groups=True).filter("groups <> ''").select(F.sha2("groups", 256).alias("h"), "groups_sha256").collect()
    assert shown and all(r.h == r.groups_sha256 for r in shown)
    assert token_alignment.align(df.limit(0), *paths).collect() == []


def test_groups_end_where_no_token_spans():
    first, last = token_alignment.links(np.array([2, 5, 6]), np.array([1, 3, 5, 6]))
    assert (first.tolist(), last.tolist()) == ([0, 1, 3], [1, 2, 3])
    assert token_alignment.unspanned(first, last, 4).tolist() == [False, False, True, True]


def test_stretches_start_between_visible_characters():
    text = "a b\nc  d \n e\u3000 f\u00a0 g é 日 ü\u0085 h \x1c i\U0001f600 j 1"
    data = np.frombuffer(text.encode(), np.uint8)
    assert [text.encode()[i:].decode()[:2] for i in token_alignment.stretch_starts(data)] == [" b", "\nc", " é", " 日", " ü", " 1"]


def test_many_equal_rows_are_dealt_over_chunks(spark, paths):
    df = spark.createDataFrame([(None, "the same words again " * 50)] * 4000, "doc_id long, text string")
    rows = token_alignment.align(df, *paths).distinct().collect()
    assert len(rows) == 1 and rows[0].n_links * 4000 <= rows[0].count_sum


# --- quality rules


def brute_counts(text):
    w = WORD.findall(text or "")
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    rnd = random.Random(4)
    prose = lambda n: " ".join(rnd.choice(["the", "of", "and", "a"]) if rnd.random() < 0.4 else "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9))) for _ in range(n)) + "."
    good = [prose(rnd.randrange(60, 300)) for _ in range(120)]
    bad = [" ".join(f"{w}{rnd.choice(['###', '$$$', '&&&'])}" for w in prose(200).split()), "0123 4567 89 " * 3 + " ".join(str(rnd.randrange(10**6)) for _ in range(300)), " ".join("ÄÖÜ" + "жщ" * rnd.randrange(1, 9) for _ in range(300))]
    odd = [None, "", " \n\t", "few words", "x " * 5000, "a b c d e f g h a b c d e f g h", "same line here\nsame line here\n\n \n\n", "word " * 300_000, prose(40_000) + prose(5)]
    texts = good + bad + odd
    rows = [(i, t, "en" if i < len(good) + len(bad) else ["xx", None][i % 2], 1, "h") for i, t in enumerate(texts)] + [(None, good[0], None, 1, "h"), (3, good[3], "en", 1, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, ref string")
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in enumerate(texts):
        r = by[i]
        n = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
    assert all(by[i].kept for i in range(len(good)))
    assert not any(by[len(good) + i].kept or by[len(good) + i].base_failed for i in range(len(bad)))
    assert by[len(good) + len(bad)].char_distance is None
    assert quality.judge(df.limit(0)).collect() == []
    assert [r.kept for r in quality.judge(df.filter("text is null")).collect()] == [False]


def test_references_hold_all_rows(spark):
    df = spark.createDataFrame([("a b b c " * 20, "en"), ("b\n", None), ("Q1!", "fr")], "text string, lang string")
    refs = {r.lang: r for r in quality.language_references(df, common=0.2, least_words=10).collect()}
    assert set(refs) == {"en", None}
    assert sorted(refs["en"].shares) == [0.25, 0.25, 0.5] and abs(sum(refs["en"].chars) - 1) < 1e-12
    assert len(refs[None].words) == 3 and abs(max(refs[None].shares) - 41 / 82) < 1e-12


def test_native_operators_have_no_python_workers(spark, sf_dir):
    plan = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

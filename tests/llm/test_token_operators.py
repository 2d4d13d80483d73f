"""Alignment, token counts and periodic runs against the libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from pactlake.llm import alignment, periodic, queries, transducer
from pactlake.llm.common import byte_letters

A, B, W = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = ["", None, "a", " ", "\n", "it's we've 'R 'LL", "▁x", "tab\there  two", "<s> </s> <|endoftext|> <0x41>", "中文 😀 é é İΣς", "\x00\x1c\x85", "word " * 20_000, "x" * 30_000]


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame(list(zip(ids, texts, ["extra"] * len(texts))), "doc_id long, text string, n_tokens string")


def noise(seed, n, letters="ab'stdmrvle 19!é中ßΣ́\n-.<|>"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


# --- 11 alignment -----------------------------------------------------------------------------------
def aligned_by_hand(rows):
    """Groups and links of each text by sets of byte offsets, then counts over all of them."""
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    out, links = [], []
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a = a_side.encode(" " + (text or ""), add_special_tokens=False)
        a_ids, b_ids = a.ids, b_side.encode(text or "")
        a_bytes = [bytes(byte_of[c] for c in t) for t in a.tokens]
        pieces = [b_side.id_to_piece(i) for i in b_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b_ids, pieces)]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append((doc_id, 0, 0, ""))
            links.append([])
            continue
        a_ends, b_ends = ([sum(map(len, side[: i + 1])) for i in range(len(side))] for side in (a_bytes, b_bytes))
        shared = sorted(set(a_ends) & set(b_ends))
        written, low = [], 0
        for high in shared:
            sides = [[i for i, end in zip(ids, ends) if low < end <= high] for ids, ends in ((a_ids, a_ends), (b_ids, b_ends))]
            written.append("|".join(",".join(map(str, side)) for side in sides))
            low = high
        out.append((doc_id, len(a_ids), len(b_ids), ";".join(written)))
        links.append([(i, j) for i, e in zip(a_ids, a_ends) for j, f in zip(b_ids, b_ends) if e == f] if len(a_ids) < 500 else [(a_ids[a_ends.index(e)], b_ids[b_ends.index(e)]) for e in shared])
    counts = Counter(pair for each in links for pair in each)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        ((*head, g.count(";") + 1 if g else 0, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for (*head, g), ls in zip(out, links)),
        key=str,
    )


def test_alignment_equals_links_by_hand(spark, tmp_path, monkeypatch):
    texts = [t for t in ODD if len(t or "") < 200] + noise(1, 150) + ["the word the other word"] * 20 + ["word " * 300]
    ids = [*range(len(texts) - 2), None, 5]  # a null and a repeated id
    table(spark, texts, ids).withColumnRenamed("n_tokens", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    want = aligned_by_hand(list(zip(ids, texts)))
    for heavy in (1 << 16, 4):  # with the second, most pairs take the way of the join
        monkeypatch.setattr(alignment, "HEAVY", heavy)
        got = queries.op11_alignment(spark, str(tmp_path))
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_alignment_of_odd_tables(spark):
    long_ = alignment.alignment(table(spark, ["word " * 20_000, "x" * 30_000, None]), A, B, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: r["n_links"] == r["n_groups"] for r in long_} == {0: True, 1: True, 2: True}
    assert [r["n_a"] for r in long_ if r["doc_id"] == 2] == [0]
    assert alignment.alignment(table(spark, ["x"]).limit(0), A, B, public_tokenizers.PATTERN).count() == 0


def test_identity_map_leads_to_the_same_bytes():
    both = alignment.vocabularies(A, B, public_tokenizers.PATTERN)
    known = np.flatnonzero(both.identity >= 0)
    assert len(known) > 10_000 and all(both.a_bytes[a] == both.b_bytes[both.identity[a]] for a in known)


# --- 12 token counts --------------------------------------------------------------------------------
def test_token_counts_equal_the_library(spark):
    texts = ODD + noise(2, 2000) + noise(3, 50, "abcdefghijklmnopqrstuvwxyz") + ["<|startoftext|>é<|endoftext|><|endoftext", "'s'S'x'r're'v've'l'll'lla'ma"]
    library = Tokenizer.from_file(W)
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = transducer.token_counts(table(spark, texts), W)
    assert got.columns == ["doc_id", "text", "n_tokens", "_n_tokens"]
    assert [r[0] for r in got.orderBy("doc_id").select("_n_tokens").collect()] == want
    assert transducer.token_counts(table(spark, ["x"]).limit(0), W).count() == 0


def test_token_counts_do_not_depend_on_chunks_or_kept_states(monkeypatch):
    texts = noise(4, 300) + ["a" * 2000, "ab" * 1500, "-" * 1000]
    machine = transducer.Counter(W)
    want = machine.counts(texts).tolist()
    assert machine.counts(texts[::-1]).tolist() == want[::-1]
    monkeypatch.setattr(transducer, "_STATES", 1)
    assert [int(machine.counts([t])[0]) for t in texts] == want
    symbols = np.array([97, 98] * 700 + [97 + 256, 98, 99 + 256], np.int64)
    assert len({tuple(machine._pairs.growth(symbols, chunk)) for chunk in (1, 3, 16, 128, 4096)}) == 1
    classes = machine._words.classes(np.array([ord(c) for c in "we've 'r're it's''ll 12 'l" * 40 + " "]))
    assert len({tuple(machine._words.begins(classes, chunk)) for chunk in (1, 2, 7, 256, 4096)}) == 1


def test_token_count_transitions_add_up_to_prefixes():
    """The growth of a word's prefixes is the growth of their encodings without a word end."""
    pairs = transducer.Counter(W)._pairs
    word = np.array([ord(c) for c in "internationalizations"], np.int64)
    assert pairs.growth(word).cumsum().min() >= 1


# --- 13 periodic runs -------------------------------------------------------------------------------
def runs_by_hand(words):
    found = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(q % d == 0 and words[i : j + q - d] == words[i + d : j + q] for d in range(1, q)):
                found.add((i, j + q - i, q))
            i = j + 1
    return sorted(found)


def repeating(rng):
    words = []
    while rng.random() < 0.8:
        q, of = rng.randrange(1, rng.choice([3, 8, 20, 60])), rng.choice([1, 2, 3, 50])
        words += ([f"w{rng.randrange(of)}" for _ in range(q)] * 8)[: rng.randrange(1, 8 * q)] if rng.random() < 0.7 else [f"w{rng.randrange(of)}" for _ in range(q)]
    return words


def test_periodic_runs_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [" \t\n".join(repeating(rng)) for _ in range(400)] + ["", None, " ", "\n", "one", " a b ", "w " * 3000, "\x1c \x85 a " * 9, " ".join(f"n{i % 700}" for i in range(3000))]
    ids = [*range(len(texts) - 2), None, 3]
    table(spark, texts, ids).withColumnRenamed("n_tokens", "n_words").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in zip(ids, texts):
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = runs_by_hand(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        digests = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode(), b" ".join(w for i, w in enumerate(words) if i not in gone))]
        want.append((doc_id, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), *digests))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert periodic.periodic_runs(table(spark, ["x"]).limit(0)).count() == 0


def test_runs_of_many_documents_in_one_sequence():
    rng = random.Random(6)
    docs = []
    for _ in range(3000):
        numbers: dict[str, int] = {}
        docs.append([numbers.setdefault(w, len(numbers)) for w in repeating(rng)])
    got = periodic.runs_of([np.array(d, np.int64) for d in docs])
    assert got == [runs_by_hand(d) for d in docs] and sum(map(len, got)) > 3000


def test_runs_of_long_periods():
    assert periodic.runs_of([np.array(list(range(50_000)) * 5), np.array([7] * 100_000), np.array(list(range(9)) * 3)]) == [[(0, 250_000, 50_000)], [(0, 100_000, 1)], []]

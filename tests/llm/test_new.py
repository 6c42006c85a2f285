"""Fill-in-middle, token counts and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrane.llm import fim, spelling, token_counts
from tests.llm.test_llm import ODD, WORDS, documents

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [*ODD, (20, "<P> holds a marker"), (21, "ends in space \t\n"), (22, "\x85a\xa0b c d"), (23, "日本 語 テキスト" * 40), (24, " x" * 900), (25, "y" * 5000), (26, "\n" * 700 + "z"), (27, "a< <S"), (28, "a <| P> b")]
TEXTS += [(i, " ".join(random.Random(i).choices([*WORDS, "é", "\n", "  "], k=i % 60))) for i in range(100, 220)]


def plain_fim(doc, text, fim_percent=50):
    text = text or ""
    units = UNIT.findall(text)
    n, form = len(units), "plain"
    if doc is not None and text and not re.search("<[PSM]>", text):
        d = hashlib.sha256(f"42:{doc}".encode()).hexdigest()
        h = [int(d[k : k + 8], 16) for k in range(0, 32, 8)]
        if h[2] % 100 < fim_percent:
            form = "spm" if h[3] % 100 < 80 else "psm"
    if form == "plain":
        return doc, n, form, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return doc, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 7, 64, 4096])
def test_fill_in_middle(spark, chunk):
    out = fim.transform(documents(spark, TEXTS), fim_percent=100, chunk=chunk).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [plain_fim(i, t, 100) for i, t in TEXTS]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted((tuple(r)[:6] for r in out), key=key) == sorted(want, key=key)
    assert Counter((r.doc_id, r.back) for r in out) == Counter((i, t or "") for i, t in TEXTS)


def test_fill_in_middle_of_an_empty_table(spark):
    assert fim.transform(documents(spark, [])).count() == 0
    assert fim.digests(documents(spark, [(1, None)])).first().output_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name, tmp_path):
    path, cache = public_tokenizers.path(name), f"file://{tmp_path}/cache"
    rows = [*TEXTS, (300, "a <|endoftext|> b"), (301, "one")]
    if name.endswith(".json"):
        tokenizer = Tokenizer.from_file(path)
        plain = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = lambda t: len(model.encode(t))
    want = Counter((i, len((t or "").encode()), plain(t or ""), plain(t or "") > 512) for i, t in rows)
    half = token_counts.count_tokens(documents(spark, rows[:30]), path, cache).collect()
    assert len(half) == 30 and not any(r.cache_hit for r in half)
    for limit in (0, 10**6):  # texts sent to the digests, digests sent to the texts; then nothing is left to encode
        got = token_counts.count_tokens(documents(spark, rows), path, cache, broadcast_digests=limit).collect()
        assert Counter(tuple(r)[:4] for r in got) == want
        assert all(r.cache_hit for r in got) == bool(limit)
    stored = spark.read.parquet(f"{cache}/{token_counts.tokenizer_digest(path)}")
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in rows})
    assert token_counts.count_tokens(documents(spark, []), path, cache).count() == 0
    assert Counter(tuple(r)[:4] for r in token_counts.count_tokens(documents(spark, rows), path, broadcast_digests=10**6).collect()) == want


def test_a_tokenizer_has_its_own_counts(spark, tmp_path):
    a, b = (token_counts.tokenizer_digest(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    assert a != b
    with pytest.raises(ValueError, match="no library"):
        token_counts.tokenizer_digest(str(tmp_path / "x.bin"))


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, every, least=5, factor=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in form.items() if n[v] >= factor * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n.get(form.get(w)) or 0) for w in n)


@pytest.mark.parametrize("every", [3, 199])
def test_spelling_variants(spark, every):
    rng = random.Random(every)
    base = ["committee", "aabbccdd", "réserve", "RÉSERVE", "naïveté", "letters", "lettres", "Aaaaaaaa", "ÀÉÎÕÜß", "x" * 400, "x" * 401, "x" * 200 + "y" + "x" * 200, "short", "sixsix"]
    words = []
    for k, w in enumerate(base):
        words += [w] * (6 + 700 * (k % 3 == 0))
        for _ in range(9):
            i, c = rng.randrange(len(w)), rng.choice("abxéÿ")
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]])] * rng.choice([1, 5, 7, 40])
    rng.shuffle(words)
    rows = [*TEXTS, (None, "committee commitee " * 3), (50, "a1bcdefg_hijklmn×÷opqrst " * 6)]
    rows += [(i, rng.choice([" ", ", ", "\n", "9"]).join(words[k : k + 90])) for i, k in enumerate(range(0, len(words), 90), 400)]
    want = plain_variants(rows, every)
    assert sum(w[1] != "" for w in want) > 20
    got = spelling.variants(documents(spark, rows), every=every).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got) == want
    assert all((r.form is None) == (r.form_n is None) for r in got)
    assert spelling.variants(documents(spark, []), every=every).count() == 0


def test_deletion_keys_are_hashes_of_the_shortened_words():
    words = ["abcdef", "aabbcc", "ééé×ÿa"]
    letters = np.array([[ord(c) for c in w] for w in words], np.uint32)
    made = spelling.deletion_keys(letters)
    for w, row in zip(words, made, strict=True):
        for i, key in enumerate(row):
            assert key == spelling.whole_key(np.array([[ord(c) for c in w[:i] + w[i + 1 :]]], np.uint32))[0]


def test_strings_decide_after_a_collision(spark):
    words = spark.createDataFrame([("letter", 50, 1), ("latter", 9, 2), ("hunter", 90, 3), ("hunters", 7, 3)], "word string, n long, wid long")
    hits = spark.createDataFrame([(w, 1, "same") for w in (1, 2, 3)] + [(1, -1, "short"), (3, 5, "long")], "wid long, place int, kind string")
    assert [tuple(r) for r in spelling.neighbours(words, hits).select("word", "n_near", "best.word").orderBy("word").collect()] == [("latter", 1, "letter"), ("letter", 1, "latter")]


def test_sorted_rows_meet_by_key_and_place():
    key = np.array([1, 1, 1, 2, 2, 2, 3, 4, 4])
    slot = np.array([-1, 2, 3, 5, 5, 7, 3, -1, 2])
    alike, other = spelling._meeting(key, slot)
    assert alike.tolist() == [False, True, True, True, True, False, False, False, False]
    assert other.tolist() == [True, False, True, False, False, False, False, False, False]

"""Text operators against brute force, on small frames and the smallest tables."""

import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrane.llm import decontaminate, fuzzy_lines, hmm, minhash, packing, quality, substrings, topk, toxicity, urls
from terrane.llm import queries as q
from terrane.llm.common import table, union_find
from terrane.llm.components import connected_components
from tests.oracle import both, connect

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, kept string, d1 string, part string, row string"


def documents(spark, texts):
    """Rows with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "x", "x", "x", "x", "x") for i, t in texts], SCHEMA)


WORDS = [f"w{i}" for i in range(200)]
LONG = " ".join(random.Random(5).choices(WORDS, k=9000))
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "Ünï x\n\nÜNÏ x"), (7, LONG), (8, LONG + " end"), (7, LONG), (None, "alone here now"), (9, "a b c d e f g h i j k l\na b c d e f g h i j k l")]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = both(q.QUERIES[name](spark, FOLDER), duck, q.ORACLE_SQL[name])
    assert ours == theirs


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3), (3, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == union_find((a, b) for a, b in pairs if a is not None and b is not None and a != b)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, size):
    w = (text or "").encode().lower().split()
    n = min(size, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute_groups(rows, size, percent=80):
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)]
    return union_find(links)


def test_near_duplicates_brute_force(spark):
    rng = random.Random(9)
    rows = list(ODD)
    for g in range(6):
        base = rng.choices(WORDS, k=60)
        for v in range(25):
            w = list(base)
            for _ in range(v % 6):
                w[rng.randrange(60)] = rng.choice(WORDS)
            rows.append((100 + 30 * g + v, " ".join(w)))
    comp = brute_groups(rows, 4)
    got = minhash.near_duplicates(documents(spark, rows), 4).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == comp.get(r.doc_id, r.doc_id) and r.kept == (r.component_id == r.doc_id)
    assert minhash.near_duplicates(documents(spark, []), 4).count() == 0
    left = minhash.deduplicate(documents(spark, rows), 4)
    assert left.columns == documents(spark, []).columns and 2 in {r.doc_id for r in left.collect()}


def test_large_family_is_searched_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    rng = random.Random(2)
    base, rows = rng.choices(WORDS, k=50), []
    for v in range(60):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(50)] = rng.choice(WORDS)
        rows.append((v, " ".join(w)))
    comp = brute_groups(rows, 4)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), 4).collect()} == {i: comp.get(i, i) for i, _ in rows}


def test_superminhash_matches_plain_walk():
    elements = np.unique(np.random.default_rng(1).integers(0, 2**63, 70).astype(np.uint64))
    owner = np.array([0] * 40 + [1] * (len(elements) - 40))
    sig = minhash.superminhash(elements, owner, 3)
    mask = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    m, plain = minhash.SLOTS, np.full((3, minhash.SLOTS), np.inf)
    for e, o in zip(elements.tolist(), owner.tolist(), strict=True):
        p = list(range(m))
        for j in range(m):
            b = mix((e + j * 0x9E3779B97F4A7C15) & mask)
            k = j + (mix(b ^ 0xD1B54A32D192ED03) >> 32) * (m - j) // (1 << 32)
            p[j], p[k] = p[k], p[j]
            plain[o, p[j]] = min(plain[o, p[j]], j + (b >> 11) * 2.0**-53)
    assert np.array_equal(sig, plain) and np.isinf(sig[2]).all()


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(4)
    off = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 600).astype(np.uint64)
        a, b = np.unique(x[:500]), np.unique(x[100:])
        s = minhash.superminhash(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 2)
        off.append((s[0] == s[1]).mean() - 400 / 600)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        n = [i]
        for j, e in enumerate(b, 1):
            n.append(min(p[j] + 1, n[-1] + 1, p[j - 1] + (c != e)))
        p = n
    return p[-1]


def normal_line(line):
    return "".join(c for c in line.lower() if c not in fuzzy_lines.SIGNS).strip(" ")


def plain_simhash(words):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_lines(rows, similarity=fuzzy_lines.SIMILARITY):
    occ, first = [], {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n") if i is not None else []):
            key = normal_line(line)
            if len([w for w in key.split(" ") if w]) >= fuzzy_lines.MIN_WORDS:
                occ.append((i, n, key))
                first[key] = min(first.get(key, (i, n)), (i, n))
    keys = sorted(first)
    sims = [plain_simhash([w for w in k.split(" ") if w]) for k in keys]
    links = []
    for a in range(len(keys)):
        for b in range(a):
            longest = max(len(keys[a]), len(keys[b]))
            if (sims[a] ^ sims[b]).bit_count() <= fuzzy_lines.DISTANCE and abs(len(keys[a]) - len(keys[b])) <= 0.2 * longest and levenshtein(keys[a], keys[b]) <= math.floor(longest * (1 - similarity) + 1e-9):
                links.append((a, b))
    comp, keep = union_find(links), {}
    for k, key in enumerate(keys):
        g = comp.get(k, k)
        keep[g] = min(keep.get(g, first[key]), first[key])
    at = {key: keep[comp.get(k, k)] for k, key in enumerate(keys)}
    return sorted((i, n, *at[key]) for i, n, key in set(occ) if (i, n) != at[key]), links


def test_fuzzy_lines_brute_force(spark):
    rng = random.Random(11)
    rows = [r for r in ODD if not (r[1] and len(r[1]) > 5000)]
    for d in range(30):
        lines = []
        for _ in range(4):
            base = random.Random(rng.randrange(6)).choices(WORDS, k=70)
            if rng.random() < 0.6:
                base[rng.randrange(70)] = rng.choice(WORDS)
            lines.append(" ".join(base) + rng.choice(["", ".", "!"]))
        rows.append((200 + d, "\n".join(lines)))
    want, links = brute_lines(rows)
    got = fuzzy_lines.fuzzy_repeats(documents(spark, rows))
    assert links and sorted((r.doc_id, r.line_no, r.kept_doc_id, r.kept_line_no) for r in got.collect()) == want
    after = {r.doc_id: r for r in fuzzy_lines.remove(documents(spark, rows), fuzzy_lines.SIMILARITY).collect() if r.doc_id is not None and r.doc_id >= 200}
    gone = defaultdict(set)
    for i, n, *_ in want:
        gone[i].add(n)
    for i, t in rows:
        if i is not None and i >= 200:
            assert after[i].text == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) and after[i].n_chars == len(after[i].text)
    assert fuzzy_lines.fuzzy_repeats(documents(spark, [])).count() == 0


def test_simhash_of_very_long_lines(spark):
    rows = [(i, " ".join(random.Random(i).choices(WORDS, k=n))) for i, n in ((1, 5), (2, 127), (3, 128), (4, 700), (5, 8192), (6, 20000))]
    got = {r.doc_id: r.sim & (2**64 - 1) for r in fuzzy_lines.lines_of(documents(spark, rows))[0].collect()}
    assert got == {i: plain_simhash(t.split(" ")) for i, t in rows}


def test_simhash_sums_several_words_a_row(spark, monkeypatch):
    """The grouped sum gets a row for every STEP words and a line's signs go in one pass; blanks count for equality only."""
    made = []
    monkeypatch.setattr(fuzzy_lines, "materialize", lambda df, name: made.append(df) or df)
    line = "one, two  three: four (five) six"
    found = fuzzy_lines.lines_of(documents(spark, [(1, line), (2, "one two  three four five six"), (3, "one two three four five six"), (4, "x " * 1000)]))[0]
    got = {r.doc_id: (r.d1, r.d2, r.sim, r.len) for r in found.collect()}
    assert got[1] == got[2] and got[2][:2] != got[3][:2] and got[2][2] == got[3][2]
    assert got[4][2] & (2**64 - 1) == plain_simhash(["x"])
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(0" in plan and " replace(" not in plan


@pytest.mark.parametrize("lines", [10, 10**7, 10**10])
def test_pigeonhole_finds_all_pairs(spark, lines):
    rng = random.Random(lines)
    base = [rng.getrandbits(64) for _ in range(20)]
    sims = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(6)]
    df = spark.createDataFrame([(i, s - (1 << 64) if s >> 63 else s, 10, i) for i, s in enumerate(sims)], "id long, sim long, len int, comp long")
    cells = fuzzy_lines._cells(df, lines, 3)
    tops = cells.groupBy("pick", "block").agg(F.min("id").alias("top"))
    want = sorted((i, j) for j in range(len(sims)) for i in range(j) if (sims[i] ^ sims[j]).bit_count() <= 3)
    assert sorted((r.a, r.b) for r in fuzzy_lines.pairs_across(cells, tops, 3, 0.8).collect()) == want
    one = df.withColumn("comp", F.lit(7).cast("long"))  # a family is not paired with itself
    cells = fuzzy_lines._cells(one, lines, 3)
    assert fuzzy_lines.pairs_across(cells, cells.select("pick", "block", F.col("comp").alias("top")).distinct(), 3, 0.8).count() == 0


def test_edit_similarity_of_pairs(spark):
    rng = random.Random(2)
    texts, pairs = [], []
    for k in range(40):
        a = rng.choices(WORDS, k=rng.randrange(1, 30))
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choices(WORDS, k=rng.randrange(3))
        texts += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        pairs.append((2 * k, 2 * k + 1))
    t = dict(texts)
    want = [p for p in pairs if levenshtein(t[p[0]], t[p[1]]) <= math.floor(max(len(t[p[0]]), len(t[p[1]])) * 0.2 + 1e-9)]
    got = fuzzy_lines._verified(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(texts, "id long, norm string"), 0.8)
    assert 5 < len(want) < 35 and sorted(map(tuple, got.collect())) == want


def test_bounds_of_the_edit_distance(spark):
    """Copies are shown by pieces and strangers by thinned texts, without their whole distance; neither says too much."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        a = " ".join(rng.choices(WORDS, k=rng.randrange(90)))
        b = "".join(rng.choice(("", c, c + c, " ", "e", "z")) if rng.random() < 0.08 else c for c in a) if k % 2 else " ".join(rng.choices(WORDS, k=rng.randrange(90)))
        rows.append((k, a, b, "\u00e9" * 600 + a, b))
    df = spark.createDataFrame(rows, "k int, ta string, tb string, u string, v string")
    pieced = fuzzy_lines._pieced
    got = df.select("k", "ta", "tb", F.levenshtein(fuzzy_lines._thinned("ta"), fuzzy_lines._thinned("tb")).alias("low"), pieced("ta", "tb").alias("high"), pieced("u", "v").alias("wide")).collect()
    assert all(r.low <= levenshtein(r.ta, r.tb) <= r.high for r in got) and all(r.wide >= 600 for r in got)
    copies = [r for r in got if r.k % 2 and len(r.ta) > 100]
    assert sum(r.high <= 0.2 * len(r.ta) for r in copies) > len(copies) / 2


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    odd = [b"".decode(), " ", "a  b", "a\n b", "a \nb", "it's  <|endoftext|> x <|endoftext|>", "don't 's", "a  b", "x　 y", "1 2 33,4 ... ! a", "tab\t b c", "a\x1c b \x85 c", LONG, None]
    rows = [(i, t) for i, t in enumerate(odd)] + [(2, "a  b")]
    got = packing.pack(documents(spark, rows), with_ids=True).collect()
    tok = Tokenizer.from_file(packing.tokenizer_file())
    assert sum(r.length for r in got) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    by, seq = defaultdict(list), defaultdict(int)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id] += r.length
        assert r.ids_crc32 == zlib.crc32(array("I", r.ids).tobytes())
    for i, t in rows:
        if i != 2:
            ids = [x for r in sorted(by[i], key=lambda r: r.start) for x in r.ids]
            assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 0] and by[i][0].doc_tokens == len(ids)
    last = max(seq)
    assert all(n == packing.SEQUENCE for s, n in seq.items() if s != last) and sorted(seq) == list(range(last + 1))
    assert packing.pack(documents(spark, [])).count() == 0


def test_decontamination_blocks_and_cleaning(spark, monkeypatch):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "tiny item"), (3, None), (4, "..."), (2, "tiny item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(10, "x ALPHA, beta gamma delta epsilon zeta eta theta iota kappa lambda. " + "y " * 30), (11, "a tiny, item here and more words to keep"), (12, "clean text"), *ODD]
    whole = sorted(map(str, decontaminate.report(documents(spark, rows), bench).collect()))
    r = {x.doc_id: x for x in decontaminate.report(documents(spark, rows), bench).collect()}
    assert (r[10].n_hit, r[10].n_items, r[11].n_hit, r[12].contaminated) == (11, 1, 2, False)
    assert r[11].items_sha256 == decontaminate.items_digest([2]) and r[12].items_sha256 == decontaminate.items_digest([])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)
    assert sorted(map(str, decontaminate.report(documents(spark, rows), bench).collect())) == whole
    left = {x.doc_id: x for x in decontaminate.clean(documents(spark, rows), bench).collect()}
    assert "tiny" not in left[11].text and left[11].text.endswith("here and more words to keep") and left[12].text == "clean text"
    assert decontaminate.report(documents(spark, []), bench).count() == 0
    assert decontaminate.clean(documents(spark, rows), bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("block", [8, 30, 1 << 20])
def test_cleaning_does_not_depend_on_blocks(spark, monkeypatch, block):
    """Overlapping items of several blocks, and shares that only add up over them."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, "d e f g h i"), (None, "z z z"), (3, "m n o")], "item_id long, text string")
    rows = [(1, "k a b c d e f g h i l " + "z y " * 20), (2, "a b c d e f m n o p q r s t"), (3, "g h i m n p")]
    got = {r.doc_id: r for r in decontaminate.clean(documents(spark, rows), bench, width=3).collect()}
    assert got[1].text.split() == ["k", "l", *["z", "y"] * 20] and set(got) == {1, 3} and got[3].text.split() == ["m", "n", "p"]
    assert {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.report(documents(spark, rows), bench, width=3).collect()} == {1: (9, 2), 2: (9, 3), 3: (3, 1)}


def plain_forward(model, symbols):
    a, total = model.start, 0.0
    for n, s in enumerate(symbols):
        a = (a if n == 0 else a @ model.step) * model.emit[s]
        total += math.log(a.sum())
        a = a / a.sum()
    return total


def plain_counts(model, symbols):
    k, n = len(model.start), len(symbols)
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    for t, s in enumerate(symbols):
        a = (model.start if t == 0 else alpha[t - 1] @ model.step) * model.emit[s]
        alpha[t] = a / a.sum()
    for t in range(n - 2, -1, -1):
        b = model.step @ (model.emit[symbols[t + 1]] * beta[t + 1])
        beta[t] = b / b.sum()
    gamma = alpha * beta
    gamma /= gamma.sum(1)[:, None]
    steps, emits = np.zeros((k, k)), np.zeros((k, len(model.emit)))
    for t in range(n):
        emits[:, symbols[t]] += gamma[t]
        if t:
            x = alpha[t - 1][:, None] * model.step * (model.emit[symbols[t]] * beta[t])[None]
            steps += x / x.sum()
    return gamma[0], steps, emits


def test_forward_backward_equals_plain_recursion():
    rng = np.random.default_rng(6)
    emit = rng.dirichlet(np.ones(30), 4).T
    model = hmm.Model(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), emit)
    seqs = [rng.integers(0, 30, n) for n in (1, 2, 63, 64, 65, 128, 129, 1000, 7)]
    starts, steps, emits, total = hmm.Sweep(model, seqs).expected()
    want = [plain_counts(model, s) for s in seqs]
    assert np.allclose(hmm.Sweep(model, seqs).entering()[1], [plain_forward(model, s) for s in seqs])
    assert total == pytest.approx(sum(plain_forward(model, s) for s in seqs))
    for got, k in ((starts, 0), (steps, 1), (emits, 2)):
        assert np.allclose(got, sum(w[k] for w in want))


def check_language_model(spark, rows):
    got = hmm.language_model(documents(spark, rows)).collect()
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    words = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    c = Counter(w for i, ws in words if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)) for i, ws in words)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    return got


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(hmm, "LEXICON", 60)
    monkeypatch.setattr(hmm, "SYMBOLS", 20)
    monkeypatch.setattr(hmm, "ROUNDS", 2)
    rng = random.Random(8)
    rows = ODD + [(100 + k, " ".join(rng.choices(WORDS[: 100 if k % 2 else 200], k=rng.randrange(200)))) for k in range(60)]
    got = check_language_model(spark, rows)
    assert all(r.score <= 1e-9 for r in got)
    assert check_language_model(spark, [(None, "a b")])[0].base_score == 0
    assert hmm.language_model(documents(spark, [])).count() == 0


def plain_model(rows, rounds):
    """Counts, symbols, training and scores of a small corpus by plain recursions over whole texts."""
    texts = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    train = [ws for i, ws in texts if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for ws in train for w in ws)
    own = [w for _, w in sorted((-n, w) for w, n in c.items() if w)][: hmm.SYMBOLS]
    symbols = {b"": 0} | {w: k for k, w in enumerate(own, 1)}
    room, kinds = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, n in c.items():
        if w not in symbols:
            room[zlib.crc32(w) % hmm.CLASSES] += n
            kinds[zlib.crc32(w) % hmm.CLASSES] += 1
    symbol = lambda w: symbols.get(w, len(symbols) + zlib.crc32(w) % hmm.CLASSES)
    own_counts = np.array([c[b""], *(c[w] for w in own)], float)
    lex = hmm.Lexicon(own, own_counts, sum(c.values()), len(c), room, kinds)  # for the first model only
    model, coded = hmm.first_model(lex), [np.array([symbol(w) for w in ws]) for ws in train]
    for _ in range(rounds):
        starts, steps, emits = (sum(x) for x in zip(*(plain_counts(model, s) for s in coded), strict=True))
        model = hmm.Model((starts + 1) / (starts + 1).sum(), (steps + 1) / (steps + 1).sum(1)[:, None], (emits.T + hmm.SMOOTH) / (emits.T + hmm.SMOOTH).sum(0))
    inside = lambda w: 0.0 if w in symbols else math.log10((c[w] + hmm.SMOOTH) / (room[zlib.crc32(w) % hmm.CLASSES] + hmm.SMOOTH * (kinds[zlib.crc32(w) % hmm.CLASSES] + 1)))
    return Counter((i, round(plain_forward(model, [symbol(w) for w in ws]) / math.log(10) + sum(map(inside, ws)), 4)) for i, ws in texts)


def test_language_model_scores_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(hmm, "LEXICON", 60)
    monkeypatch.setattr(hmm, "SYMBOLS", 20)
    rng = random.Random(3)
    rows = [(100 + k, " ".join(rng.choices(WORDS[: 100 if k % 2 else 200], k=rng.randrange(90)))) for k in range(40)] + [(1, None), (None, "w1 x"), (7, "w1 w2"), (7, "w1 w2")]
    got = Counter((r.doc_id, round(r.score, 4)) for r in hmm.language_model(documents(spark, rows), rounds=2).collect())
    assert got == plain_model(rows, 2)


def test_language_model_beats_unigrams(spark):
    rows = [r for r in hmm.language_model(table(spark, FOLDER, "documents")).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_word_probabilities_sum_to_one():
    words, counts = [b"a", b"b", b"c"], np.array([4, 9, 5, 2], float)
    lex = hmm.Lexicon(words, counts, 20, 4, np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES))
    assert sum(10 ** lex.base(np.append(counts, 0.0))) == pytest.approx(1)


def test_topk_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SEGMENT", 40)
    monkeypatch.setattr(topk, "GROUP", 3)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(150)]
    rows += [(200, None), (220, []), (240, [1.0, None]), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (None, [1.0] * 6)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=20).collect()
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows[:150]]
    want = []
    for i, v in ok:
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, u, strict=True)), j) for j, u in ok if j != i)[:20]
            want += [(i, n, j, -x) for n, (x, j) in enumerate(s, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_url_aliases_and_allow_precedence(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", None), (2, "http://b.org/es/1", ""), (3, "http://b.net/de/1", None), (4, None, None), (5, "nothing", None), (6, "http://c.org/y?k=1#z", None), (1, "http://a.org/x", None)], "page_id long, url string, html string")
    edges = spark.createDataFrame([("http://a.org/x", "http://m.io/"), ("http://m.io/", "http://b.org/es/1"), ("http://b.net/de/1", "http://a.org/x"), ("https://c.org/y?k=1", "http://b.net/de/1"), (None, "http://a.org/x")], "a string, b string")
    got = sorted((r.page_id, r.verdict, r.rule, r.decided_by) for r in urls.judge(pages, urls.rule_table(spark, urls.RULES), edges).collect())
    assert got == [(1, "block", None, "alias"), (1, "block", None, "alias"), (2, "block", "org/es/", "rule"), (3, "allow", "net/de/", "rule"), (4, "allow", None, "default"), (5, "allow", None, "default"), (6, "block", None, "alias")]


LINKS = [
    ("https://A.example/x", '<link rel="canonical" href="https://bad.example/p">', "https://bad.example/p"),
    ("https://a.example/x", "<LINK HREF='//bad.example/p?q=1&amp;r=2' REL='canonical'>", "https://bad.example/p?q=1&r=2"),
    ("https://a.example/d/x", '<link href=/root rel=canonical>', "https://a.example/root"),
    ("https://a.example/d/x", '<link rel="canonical" href="next">', "https://a.example/d/next"),
    ("https://a.example", '<link rel="canonical" href="next">', "https://a.example/next"),
    ("http://a.example/x", '<meta http-equiv="refresh" content="0; url=https://bad.example/p">', "https://bad.example/p"),
    ("http://a.example/x", "<meta content='5;URL=/moved' http-equiv='Refresh'>", "http://a.example/moved"),
    ("http://a.example/x", '<link rel="stylesheet" href="a.css"><p>canonical refresh</p>', None),
    ("http://a.example/x", None, None),
    (None, '<link rel="canonical" href="https://bad.example/p">', None),
]


def test_links_in_html(spark):
    for k, (url, html, want) in enumerate(LINKS):
        got = [r.b for r in urls.edges_in(spark.createDataFrame([(k, url, html)], "page_id long, url string, html string")).collect()]
        assert got == ([want] if want else []), (url, html)


def test_aliases_from_html(spark):
    """A chain and a cycle of links reach a blocked url; an allow inside the blocked component stays; long html is read whole."""
    canonical = lambda to: f"<p>{'x ' * 20000}</p><link rel=canonical href='{to}'>"
    rows = [(1, "https://one.site/a", canonical("https://two.site/b"), "x"), (2, "https://two.site/b", canonical("https://three.site/c"), "x"), (3, "https://three.site/c", canonical("https://one.site/a"), "x"), (4, "https://four.site/d", canonical("https://three.site/c"), "x"),
            (5, "https://bad.site/e", canonical("https://four.site/d"), "x"), (6, "https://good.bad.site/ok/1", canonical("https://bad.site/e"), "x"), (7, "https://far.site/", None, "x"), (7, "https://far.site/", None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    rules = urls.rule_table(spark, [("block", "bad.site", "/"), ("allow", "good.bad.site", "/ok"), ("block", "good.bad.site", "/ok")])
    got = {r.page_id: (r.verdict, r.decided_by) for r in urls.judge(pages, rules).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("block", "alias"), 5: ("block", "rule"), 6: ("allow", "rule"), 7: ("allow", "default")}
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_url_rules_beyond_broadcast(spark, monkeypatch):
    pages = table(spark, FOLDER, "pages")
    rules = urls.rule_table(spark, urls.RULES)
    want = sorted(map(tuple, urls.judge(pages, rules).collect()), key=str)
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, urls.judge(pages, rules).collect()), key=str) == want


def test_substrings_keep_earliest_rank(spark):
    unit = "One two three four five six seven eight nine ten eleven"
    rows = [(3, f"{unit}\nmore"), (1, f"short\n{unit.upper()}"), (2, f"{unit}  \n{unit}"), (4, None)]
    df = documents(spark, rows).withColumn("n_chars", F.col("doc_id") * -1)
    got = sorted((r.doc_id, r.start, r.kept_doc_id, r.kept_start) for r in substrings.repeats(df, rank="n_chars").collect())
    assert got == [(1, 6, 3, 0), (2, 0, 3, 0), (2, len(unit) + 3, 3, 0)]
    left = {r.doc_id: r for r in substrings.clean(df, rank="n_chars").collect()}
    assert {i: r.text for i, r in left.items()} == {3: rows[0][1], 1: "short\n", 2: "", 4: None}
    assert [tuple(x) for x in left[1].removed] == [(6, 6 + len(unit), 3, 0)] and left[3].removed == [] and left[1].sig == "x"
    assert substrings.remove(df).columns == df.columns
    assert substrings.repeats(documents(spark, ODD)).count() == 2  # of 5 and 9; the rows of 7 stand in one place
    assert substrings.repeats(documents(spark, ODD), min_words=5).count() == 1
    assert substrings.repeats(documents(spark, [])).count() == 0 and substrings.clean(documents(spark, [])).count() == 0


def test_rows_of_one_id_lose_only_their_own_text(spark):
    u, v = "one line that stands in two places here", "words of another text at all, really nowhere else"
    rows = [(1, u), (2, u), (2, v)]
    assert sorted(r.text for r in substrings.remove(documents(spark, rows)).collect()) == sorted([u, "", v])
    assert sorted(r.text for r in fuzzy_lines.remove(documents(spark, rows)).collect()) == sorted([u, "", v])


@pytest.mark.parametrize(("operator", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, operator, label):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    known = {r.doc_id: r[label] for r in labels.collect()}
    rows = [r for r in operator.report(docs, labels).collect() if r.held_out and r.doc_id in known]
    right = sum(r.predicted == known[r.doc_id] for r in rows) / len(rows)
    assert len(rows) > 50 and right > 0.93
    none = labels.limit(0)
    assert len({r.score for r in operator.report(documents(spark, ODD), none).collect()}) == 1
    assert operator.report(documents(spark, []), labels).count() == 0


def test_offending_sentences_are_located(spark):
    rows = [(i, f"The day was fine. You are {'a vile fool' if i % 3 == 0 else 'a good friend'}! We left at {i}.") for i in range(60)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    hits = toxicity.locate(docs, model).collect()
    assert {r.doc_id for r in hits} == {i for i in range(60) if i % 3 == 0} and all("vile fool" in r.sentence for r in hits)
    assert {r.doc_id for r in toxicity.remove_toxic(docs, labels).collect()} == {i for i in range(60) if i % 3}


def test_noisy_or():
    m = toxicity.Model({b"bad": 1.0}, 0.0, 0.1)
    p = 1 / (1 + math.exp(-1))
    assert m.score(b"bad. fine. so Bad!") == pytest.approx(1 - 0.9 * (1 - p) ** 2) and m.score(b"") == pytest.approx(0.1)
    assert m.score(b"bad bad") == m.score(b"bad") and m.judge(b"fine. it is bad. bad")[1][:2] == (5, 15) and m.judge(b"fine")[1] is None


def test_noisy_or_gradient():
    rng = np.random.default_rng(4)
    word, sentence = rng.integers(0, 5, 30), np.sort(rng.integers(0, 12, 30))
    doc, y = np.sort(rng.integers(0, 6, 12)), np.array([0, 1, 0, 1, 1, 0.0])
    theta = rng.normal(0, 0.5, 7)
    grad = toxicity.loss_and_gradient(theta, word, sentence, doc, y)[1]
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        slope = (toxicity.loss_and_gradient(theta + step, word, sentence, doc, y)[0] - toxicity.loss_and_gradient(theta - step, word, sentence, doc, y)[0]) / 2e-6
        assert slope == pytest.approx(grad[k], abs=1e-6)


def test_worst_sentence_is_reported(spark):
    rows = [(i, f"All is well here. {'You vile grobnak.' if i % 2 else 'You kind soul.'} See you") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    for r in toxicity.report(documents(spark, rows), labels).collect():
        assert r.predicted == r.doc_id % 2 and (not r.doc_id % 2 or rows[r.doc_id][1][r.worst_start : r.worst_end].strip() == "You vile grobnak")


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = table(spark, FOLDER, "documents")
    names = docs.columns
    before = {r.doc_id for r in docs.collect()}
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, FOLDER)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == names
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            now = {r.doc_id for r in docs.collect()}
            assert now <= before and len(now) > 0.8 * len(before)
            before = now
    assert {r.doc_id for r in docs.collect()} == before


def test_a_second_run_leaves_the_first_ones_result(spark):
    import corpus_pipeline as cp

    first = cp.run(spark, FOLDER)
    second = cp.run(spark, FOLDER)
    rows = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    want = rows(second)
    assert want and rows(first) == want


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as cp

    rows = [*ODD, (None, None), (None, ""), (20, LONG), (21, "x\n" * 300)]
    schema = table(spark, FOLDER, "documents").schema
    full = lambda some: spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in some], schema)
    for name, stage in cp.STAGES:
        assert stage(spark, full([]), FOLDER).count() == 0
        got = Counter((r.doc_id) for r in stage(spark, full(rows), FOLDER).collect())
        gone = Counter(i for i, _ in rows) - got
        if name == "near_dedup":  # of 4 and 5, and of 7, 8 and 20, one stays
            assert set(gone) == {5, 8, 20}
        else:
            assert not gone


def test_toxicity_query_on_held_out_documents(spark):
    """Documents whose labels were not learned from are told apart; clean ones are left alone."""
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in q.QUERIES["op8_toxicity"](spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    assert got.keys() == {r.doc_id for r in table(spark, folder, "documents").select("doc_id").collect()}
    held = [i for i in labels if i in got and zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    right = sum(got[i].predicted == labels[i] for i in held)
    clean = [i for i in held if labels[i] == 0]
    assert len(held) > 50 and right >= 0.9 * len(held) and sum(got[i].predicted for i in clean) <= 0.05 * len(clean)

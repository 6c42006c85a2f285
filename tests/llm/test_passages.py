"""Repeated passages against brute force over every window."""

import random

import pytest

from terrane.llm import passages
from terrane.llm import queries as q
from tests.llm.test_llm import ODD, WORDS, documents

WIDTH = 12


def brute_spans(rows, width):
    """Words' spans of every window that stands in an earlier place, merged."""
    first, out = {}, {}
    for i, text in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        raw, spans, at = text, [], 0
        for w in raw.encode().lower().split():
            a = raw.encode().lower().index(w, at)
            at = a + len(w)
            spans.append((len(raw.encode()[:a].decode()), len(raw.encode()[:at].decode())))
        words = raw.encode().lower().split()
        cuts = []
        for k in range(len(words) - width + 1):
            key, start, end = tuple(words[k : k + width]), spans[k][0], spans[k + width - 1][1]
            doc, kept_end = first.setdefault(key, (i, end))
            if (doc, kept_end) != (i, end):
                cuts.append((max(start, kept_end) if doc == i else start, end))
        for a, b in sorted(cuts):
            mine = out.setdefault(i, [])
            if mine and a <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], b)
            else:
                mine.append([a, b])
    return sorted((i, a, b) for i, s in out.items() for a, b in s)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_inside_lines(spark, seed):
    rng = random.Random(seed)
    planted = [rng.choices([*WORDS, "Ünï", "ÉTÉ"], k=n) for n in (12, 13, 20, 40, 11)]
    rows = [*ODD, (30, "a " * 60), (31, "a b " * 40), (32, "x " + "a b " * 9)]
    for i in range(40, 70):
        parts = [rng.choices(WORDS, k=rng.randrange(4, 25))]
        for p in rng.sample(planted, 2):
            a = rng.randrange(3)
            parts += [p[a:], rng.choices(WORDS, k=rng.randrange(4, 25))]
        rows.append((i, rng.choice([" ", "  ", "\t"]).join(w for part in parts for w in part)))
    want = brute_spans(rows, WIDTH)
    assert any(i >= 40 for i, _, _ in want)
    assert sorted((r.doc_id, r.start, r.end) for r in passages.repeats(documents(spark, rows), width=WIDTH).collect()) == want


def test_query_finds_a_passage_inside_a_line(spark, tmp_path):
    p = " ".join(random.Random(4).choices(WORDS, k=60))
    rows = [(1, f"head {p} tail"), (2, f"other start\nbefore {p} after"), (3, p[:40])]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.start, r.end, r.kept_doc_id, r.kept_start, r.copies) for r in q.QUERIES["op2_passage_dedup"](spark, str(tmp_path)).collect()]
    assert got == [(2, 19, 19 + len(p), 1, 5, 2)]
    kept = q.QUERIES["op2_substring_dedup"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.text, r.n_removed) for r in kept} == {(i, t, 0) for i, t in rows}  # no whole line repeats

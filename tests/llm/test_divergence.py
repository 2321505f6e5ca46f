import random
import re
from collections import Counter, defaultdict

import pytest

from lectern.llm import divergence

WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]


def rows_of():
    rng = random.Random(3)
    rows = []
    for i in range(700):
        s = rng.choice("ABCD")
        lang = rng.choice(["en", "en", "de", None])
        words = [WORDS[min(int(rng.expovariate(0.02 if s == "A" else 0.05)), 299)].upper() if rng.random() < 0.2 else WORDS[rng.randrange(300)] for _ in range(rng.randint(0, 60))]
        rows.append((i, "3 ".join(words), lang, f"src{s}" if rng.random() < 0.95 else None, 1))
    rows += [(800 + k, t, "en", "odd", 2) for k, t in enumerate(["", None, "Éß_x1y\x00z", "ÉCOLE école Ecole", "12 34", "a" * 700_000 + " b"])]
    rows += [(900, "only here", "xx", "lone", 3), (901, None, "yy", "p", 3), (902, None, "yy", "q", 3)] + [(903, "same same", "en", "srcA", 1)] * 3
    return rows


def plain(rows, top):
    """The contract, term by term."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in term.findall(text or "")]
        count[lang, source].update(found), count[lang].update(found), docs[lang].update(set(found)), groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= 3]
        p = {}
        for s in [None, *sources]:
            c = count[lang] if s is None else count[lang, s]
            whole = sum(c[t] for t in kept) + len(kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 1) // whole for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            for part, values in (
                ("pair", [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]),
                ("term", [(t, f(p[s][t], p[None][t])) for t in kept if count[lang, s][t] and p[s][t] > p[None][t]]),
            ):
                ranked = sorted(values, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(ranked) if part == "pair" or k < top}
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), "doc_id long, text string, lang string, source string, term int").repartition(5).cache()


def test_audit_is_the_contract(docs):
    got = [tuple(r) for r in divergence.audit(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows_of(), 200)
    assert divergence.audit(docs.limit(0)).count() == 0


@pytest.mark.parametrize("top,growth", [(1, 2), (3, 2), (10, 4)])
def test_waves_end_where_bounds_fall_below(docs, top, growth):
    """Ties at the last rank are frequent in this table, so an early stop would show."""
    postings, groups = divergence.term_counts(docs)
    got = {(r.lang, r.source, "term", r.item, r.value, r["rank"]) for r in divergence.marking_terms(postings, groups, top, growth).collect()}
    assert got == {r for r in plain(rows_of(), top) if r[2] == "term"}


def test_pieces_are_the_terms_of_the_whole(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 7)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aB é1_ßz") for _ in range(rng.randint(0, 60))).encode()
        got = [t for part in divergence.pieces(text) for t in part]
        assert got == re.findall(rb"[a-zA-Z\x80-\xff]+", text.lower()) if text else got == []


def test_shares_are_exact_beyond_long(spark):
    got = spark.sql("SELECT 9000000000000000000L n, 9100000000000000000L w").select(divergence.share("n", "w")).first()[0]
    assert got == 1 + 10**9 * (9 * 10**18 + 1) // (91 * 10**17)

"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, fingerprints, license_scan, line_dedup, mixing, ngram_join, packing, quality, token_counts, toxicity
from lectern.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, node long, sig long"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank texts, one word, copies, near copies, repeated rows, a very long text, clashing columns."""
    rng = random.Random(4)
    base = words(rng, 60)
    texts = {1: None, 2: "", 3: " \n\t", 4: "one", 5: "ONE", 6: "a b c", 7: " ".join(base), 8: " ".join(base).upper(), 9: " ".join([*base[:59], "other"]), 10: "\n".join(base)}
    for i in range(11, 40):
        edited = list(base)
        for _ in range(rng.randrange(1, 9)):
            edited[rng.randrange(60)] = f"e{rng.randrange(1000)}"
        texts[i] = " ".join(edited)
    texts[40] = " ".join(words(rng, 20_000))
    texts[41] = texts[40] + " tail"
    texts[42] = "é ü ñ 漢字 <|endoftext|>\nline two 7\nline"
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x", 1, 2) for i, t in texts.items()]
    rows += [rows[6], (43, None, None, None, None, None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return frame(spark, awkward).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(sets, percent):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("percent,frequent", [(75, 32), (75, 1), (60, 3)])
def test_ngram_join(docs, awkward, percent, frequent):
    sets = {r[0]: shingles(r[1]) for r in awkward}
    want = groups(sets, percent)
    got = ngram_join.near_duplicates(docs, percent=percent, frequent=frequent).collect()
    assert len(got) == len(awkward)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {k: (len(sets[k]), want[k]) for k in sets}


@pytest.mark.parametrize("percent", [51, 66])
def test_ngram_join_of_small_sets(spark, percent):
    """Sets of one to four shingles, of tokens that are in few and in many documents."""
    rows = [(i, " ".join("abcdefghijkl"[k : k + 5 + n])) for i, (k, n) in enumerate((k, n) for k in range(4) for n in range(4))]
    rows += [(100 + i, f"a b c d e f {i}") for i in range(50)] + [(200, "a b c d e f")]
    sets = {i: shingles(t) for i, t in rows}
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == groups(sets, percent)


def test_ngram_join_copies_of_one_text_do_not_pair(spark, monkeypatch):
    """Copies of one text, each edited too much to link, share a passage that the text has not: few of their pairs are met."""
    rng, kept, sides = random.Random(3), [], ngram_join._sides
    base = [f"w{i}" for i in range(150)]

    def edited(k, places):
        return " ".join(f"e{k}" if i in places else "same" if k and i == 75 else w for i, w in enumerate(base))

    rows = [(0, " ".join(base))] + [(k, edited(k, set(rng.sample(range(10, 60, 5), 2) + rng.sample(range(90, 140, 5), 2)))) for k in range(1, 81)]
    rows += [(100 + k, edited(k, {100 + 5 * k}).replace("same", "w75")) for k in range(3)] + [(200, rows[5][1] + " more"), (201, rows[5][1] + " still more")]
    monkeypatch.setattr(ngram_join, "_sides", lambda *x: kept.append(sides(*x)) or kept[-1])
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {i: shingles(t) for i, t in rows}
    assert {r["doc_id"]: r["component_id"] for r in got} == groups(sets, 75)
    fits = "175 * least(s_a, s_b) >= 75 * (n_a + n_b)"
    assert len(kept) == 2 and sum(x.where(fits).count() for x in kept) <= 4 * len(rows)


def test_parity_tells_how_far_sets_are_apart():
    """The bits that differ are no more than the tokens that one of two sets has, and as many if those are few."""
    import numpy as np

    rng = np.random.default_rng(2)
    for size, off in ((0, 1), (40, 3), (500, 30), (5000, 400)):
        both, one, other = (rng.integers(0, 1 << 44, n).astype(np.uint64) for n in (size, off, off // 2))
        a, b = np.unique(np.concatenate((both, one))), np.unique(np.concatenate((both, other)))
        differ = sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(ngram_join.parity(a), ngram_join.parity(b)))
        apart = len(np.setxor1d(a, b))
        assert differ <= apart and (apart - differ) % 2 == 0 and (off > 3 or differ >= apart - 2)


def test_ngram_join_empty_and_long(spark, nothing, monkeypatch):
    from lectern.llm import words as hashed

    assert ngram_join.near_duplicates(nothing).count() == 0
    rng = random.Random(12)
    texts = [b"", b" \n", b"one", b"x" * 5000, " ".join(words(rng, 4000)).encode(), "é\tÜ".encode(), b"a1 b"]
    whole = hashed.words_of(texts)
    monkeypatch.setattr(hashed, "SLICE_BYTES", 700)
    cut = hashed.words_of(texts)
    assert all((x == y).all() for x, y in zip(whole[:5], cut[:5])) and cut.counts.tolist() == [len(t.split()) for t in texts]
    assert cut.digits.tolist() == [any(48 <= c < 58 for c in w) for t in texts for w in t.split()]


def test_ngram_join_blocks_do_not_grow_with_the_corpus(spark, monkeypatch):
    """With a hundred times as many token ranges, a document's tokens do not each come with an id of their own."""
    import pyarrow as pa

    rng, made, blocks = random.Random(8), [], ngram_join._token_blocks
    rows = [(i, " ".join(words(rng, 400))) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "text"])

    class Made(Exception):
        pass

    def make(*x):
        made.append(blocks(*x))
        raise Made

    monkeypatch.setattr(ngram_join, "_token_blocks", make)
    for partitions in (10, 1000):
        monkeypatch.setattr(ngram_join, "shuffle_partitions", lambda _: partitions)
        with pytest.raises(Made):
            ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    few, many = (sum(len(x) for out in run(iter([batch])) for x in out.column(out.schema.get_field_index("block")).to_pylist()) for run in made)
    assert many < 1.5 * few


def test_ngram_join_of_many_spans(spark, docs, awkward, monkeypatch):
    """Buckets of many spans, and blocks of few tokens, give the same groups."""
    for name, value in (("SPAN_TOKENS", 400), ("TOKEN_BUCKETS", 2), ("FLUSH_TOKENS", 300)):
        monkeypatch.setattr(ngram_join, name, value)
    sets = {r[0]: shingles(r[1]) for r in awkward}
    got = ngram_join.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {k: (len(sets[k]), n) for k, n in groups(sets, 75).items()}


def test_signatures_meet():
    """Sets with enough in common always share a signature, whatever the frequencies."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(3, 200))
        common = np.arange(1, n + 1, dtype=np.uint64)
        often = rng.integers(2, 80, 2 * n + 2).astype(np.uint32)
        for extra in range(int(n / 3) + 1):
            a, b = common[: n - extra // 2], common[extra - extra // 2 :]
            inter = len(np.intersect1d(a, b))
            if inter and 100 * inter >= 75 * (len(a) + len(b) - inter) and len(a) > 2 and len(b) > 2:
                x = ngram_join.signatures(a, often[a.astype(int)], len(a), 75, 20)
                y = ngram_join.signatures(b, often[b.astype(int)], len(b), 75, 20)
                if not np.array_equal(a, b):
                    assert len(np.intersect1d(x, y))


def test_license_scan(spark, docs, nothing):
    name, text = "gpl-3-notice", license_scan.TEMPLATES["gpl-3-notice"]
    rng = random.Random(2)
    rows = [(100, " ".join([*words(rng, 500), text, *words(rng, 300)])), (101, text), (102, text.rsplit(" ", 6)[0]), (103, None), (104, "")]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["template"]) for r in found} == {(100, name), (101, name)}
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(nothing).count() == 0


def test_mixing_meets_targets(spark, nothing):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, 30)), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b"]), 1, None, None, None) for i in range(600)]
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "fr": 0.3}, "topic": {"list": 0.0, "notes": 1.0}}
    got = mixing.mixture(frame(spark, rows), targets).toPandas()
    kept = got[got.sampled]
    assert 0.4 < kept[kept.source == "a"].n_tokens.sum() / kept.n_tokens.sum() < 0.6
    weight = (got.n_tokens * got.weight).groupby(got.lang).sum() / (got.n_tokens * got.weight).sum()
    assert abs(weight["en"] - 0.6) < 0.02 and abs(weight["other"] - 0.1) < 0.02
    assert (got.probability <= 1).all() and mixing.mixture(nothing, targets).count() == 0


def test_mixing_awkward(docs, awkward):
    got = mixing.mixture(docs).toPandas()
    assert len(got) == len(awkward) and (got[got.n_tokens == 0].probability == 0).all() and not got.sampled.isna().any()


@pytest.mark.parametrize("operator,column", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers(spark, docs, awkward, nothing, operator, column):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        bad = i % 3 == 0
        w = words(rng, 60)
        for _ in range(6 * bad):
            w[rng.randrange(60)] = rng.choice(["blightword", "vileness"]) + ("$$" if column == "quality" else "")
        rows.append((i, " ".join(w), "en", "s", 1, None, None, None))
        labels.append((i, 1 - bad if column == "quality" else int(bad)))
    known = spark.createDataFrame(labels, f"doc_id long, {column} int")
    got = operator(frame(spark, rows), known).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    want = [dict(labels)[i] for i in held.doc_id]
    assert (held.predicted == want).mean() > 0.9 and got.score.between(0, 1).all()
    none = operator(docs, known.where("false")).toPandas()
    assert len(none) == len(awkward) and none.score.between(0, 1).all()
    assert operator(nothing, known).count() == 0


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    from lectern.llm import labelled

    rows = [(i, f"text {i}", "en", "s", 1, None, None, None) for i in range(200)]
    known = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = labelled.sample(frame(spark, rows), known, F.col("quality"), {0: 1000, 1: 1000})
    assert {int(t.split()[1]) for _, t in got} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}


def test_fingerprints(spark, docs, awkward, nothing):
    unique = [r for r in awkward if r[0] != 7] + [next(r for r in awkward if r[0] == 7)]
    order = sorted(unique, key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(frame(spark, unique).repartition(3)).collect()}
    assert len(got) == len(unique)
    for r, following in zip(order, [*order[1:], order[0]]):
        text, after = r[1] or "", following[1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[r[0]]["n_chars"] == len(text) and got[r[0]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[r[0]]["near_edited"] <= 1
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[4]["fingerprint"]
    assert fingerprints.edited_fingerprints(docs).count() == len(awkward)
    assert fingerprints.edited_fingerprints(nothing).count() == 0
    one = fingerprints.edited_fingerprints(frame(spark, [(5, "abc, def. ghi", None, None, None, None, None, None)])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abc, def.abc,").hexdigest()


def test_fingerprints_add_up(spark):
    rows = [(1, "one.two.", "two."), (2, "b\na\nb\n", "b\n"), (3, "", "")]
    df = spark.createDataFrame(rows, "i int, whole string, part string")
    df = fingerprints.with_vector(fingerprints.with_vector(df, "whole", "w"), "part", "p")
    df = df.withColumn("rest", F.when(F.col("i") == 1, "one.").when(F.col("i") == 2, "b\na\n").otherwise(""))
    df = fingerprints.with_vector(df, "rest", "r")
    for r in df.select((fingerprints.remove(F.col("w"), F.col("p")) == F.col("r")).alias("less"), (fingerprints.combine(F.col("r"), F.col("p")) == F.col("w")).alias("more")).collect():
        assert r["less"] and r["more"]
    swapped = fingerprints.with_vector(spark.createDataFrame([("a.\nb.\n",), ("b.\na.\n",)], "t string"), "t", "v").select("v").distinct()
    assert swapped.count() == 1


def test_line_dedup(spark, awkward, nothing):
    rng = random.Random(6)
    rows = []
    for i in range(30):
        lines = [" ".join(words(rng, 9)) for _ in range(5)]
        if i < 8:
            lines.insert(i % 5, "Subscribe now to our letter")
            lines.insert(5 - i % 4, f"Copyright {2000 + i} by the {rng.choice(['Acme', 'Bolt', 'Crux'])} company all rights reserved here")
        rows.append((i, "\n".join(lines)))
    copies = rows[20][1]
    rows += [(100 + i, copies) for i in range(6)] + [(200 + i, copies.replace("7", "8", 1)) for i in range(2)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "Subscribe now to our letter")]
    got = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = text if i >= 8 or not text else "\n".join(x for x in text.split("\n") if not x.startswith(("Subscribe", "Copyright")))
        assert got[i]["text"] == want, i
    out = line_dedup.drop_recurring_lines(frame(spark, awkward))
    assert out.count() == len(awkward) and set(SCHEMA.replace(" long", "").replace(" string", "").split(", ")) <= set(out.columns)
    assert line_dedup.drop_recurring_lines(nothing).count() == 0


def deduplicated(spark, rows):
    return {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def prose(rng, n):
    return [" ".join(words(rng, 9)) for _ in range(n)]


def test_line_dedup_copies_do_not_withdraw_support(spark):
    rng, line = random.Random(7), "Subscribe now to our letter"
    base, rows = prose(rng, 12), []
    for i in range(330):
        lines = list(base) if i >= 30 else prose(rng, 12)
        for k in range(12 * (i >= 30)):
            lines[k] = " ".join(w if rng.random() > 0.02 else f"e{rng.randrange(10**6)}" for w in lines[k].split())
        rows.append((i, "\n".join([*lines[:5], line, *lines[5:]])))
    got = deduplicated(spark, rows)
    assert all(got[i] == text.replace(line + "\n", "") for i, text in rows)


def test_line_dedup_blocks(spark):
    rng = random.Random(8)
    block = prose(rng, 20)
    rows = [(i, "\n".join([*prose(rng, 10), *block[:10], "", *block[10:], *(prose(rng, 10) if i % 2 else [])])) for i in range(40)]
    got = deduplicated(spark, rows)
    assert all(not set(block) & set(got[i].split("\n")) and len(got[i].split("\n")) == 11 + 10 * (i % 2) for i, _ in rows)


def test_line_dedup_templates(spark):
    """Long lines with a varying word, and two families in one leaf, the lesser of which has less than half of its lines."""
    rng = random.Random(9)
    plain = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    families = [[f"see our site {' '.join(plain(n))} NAME {' '.join(plain(n))}" for _ in range(2)] for n in (5, 40)]
    rows = []
    for i in range(40):
        shared = [f[i % 3 == 0].replace("NAME", plain(1)[0]) for f in families]
        rows.append((i, "\n".join([*prose(rng, 6), *(shared if i < 36 else [f"see our site {' '.join(plain(11))}"])])))
    got = deduplicated(spark, rows)
    assert all(got[i] == "\n".join(x for x in text.split("\n") if i >= 36 or not x.startswith("see our")) for i, text in rows)


def test_line_dedup_two_unlike_documents(spark):
    """A passage of 60 words in two documents, in a document and its copies, and in two families of copies."""
    rng = random.Random(10)
    one, two, three, short = " ".join(words(rng, 60)), " ".join(words(rng, 60)), " ".join(words(rng, 60)), " ".join(words(rng, 20))
    text = lambda *lines: "\n".join([*prose(rng, 5), *lines, *prose(rng, 3)])
    copied, a, b = text(two), text(three), text(three)
    rows = list(enumerate([text(one, short), text(one, short), *[copied] * 6, *[a] * 4, *[b] * 4]))
    got = deduplicated(spark, rows)
    assert all(got[i] == "\n".join(x for x in t.split("\n") if x not in (one, three)) for i, t in rows)


def test_packing(docs, awkward, nothing):
    from tokenizers import Tokenizer
    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert packing.ByteBPE()("a <|endoftext|> b") == t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in awkward}
    rows = packing.pack_documents(docs).collect()
    pieces, used = defaultdict(Counter), defaultdict(list)
    for r in rows:
        got = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(got) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in got)) == r["ids_crc32"]
        pieces[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
        used[r["sequence_id"]].append((r["offset"], r["length"], r["tier"]))
    copies = Counter(r[0] for r in awkward)
    for doc, at in pieces.items():
        assert at == {i: copies[doc] for i in range(len(ids[doc]))}
    padding = 0
    for parts in used.values():
        end = 0
        for offset, length, _ in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    assert padding <= 0.01 * sum(map(len, ids.values()))
    assert packing.pack_documents(nothing).count() == 0


def test_packing_tiers_and_step_groups():
    import numpy as np

    rng = random.Random(11)
    packer, want = packing.Packer(7 << 40), 0
    lengths = [rng.choice([1, 2, 30, 100, 128, 129, 200, 256, 300, 512, 513, 700, 1023, 1024, 1025, 5000]) for _ in range(9000)]
    for doc, n in enumerate(lengths):
        packer.add(doc, np.full(n, doc, dtype="<u4"))
        want += n
    packer.finish()
    sequences, groups, tier, parts = Counter(), Counter(), {}, Counter()
    for doc, start, length, _, total, sequence, offset, size, group in packer.groups.rows:
        sequences[sequence] += length
        groups[group] += length
        tier[sequence] = size
        parts[doc] += total < packing.LONGEST
    assert sum(sequences.values()) == want and all(n == tier[s] for s, n in sequences.items())
    assert sorted(groups) == list(range(7 << 40, (7 << 40) + len(groups)))
    totals = [groups[g] for g in sorted(groups)][:-2]
    assert all(0 <= packing.STEP_TOKENS - n < packing.LONGEST for n in totals) and sum(n == packing.STEP_TOKENS for n in totals) > 0.8 * len(totals)
    assert sum(n == 1 for n in parts.values()) > 0.75 * sum(n > 0 for n in parts.values())  # most documents that a sequence can hold are not cut

    # short documents alone are packed in their own tier, and the gaps of long windows take short ones
    def tiers(lengths):
        p = packing.Packer(0)
        for doc, n in enumerate(lengths):
            p.add(doc, np.zeros(n, dtype="<u4"))
        p.finish()
        return Counter(r[7] for r in {r[5]: r for r in p.groups.rows}.values()), p.groups.rows

    assert tiers([100] * 128)[0] == {128: 100} and tiers([256] * 8)[0] == {256: 8}
    found, rows = tiers([700] * 10 + [324] * 10)
    assert found == {1024: 10} and sorted((r[2], r[6]) for r in rows) == [(324, 700)] * 10 + [(700, 0)] * 10


def test_exact_dedup(spark, docs, awkward, nothing):
    want = defaultdict(list)
    for r in awkward:
        want[lower(r[1])].append(r[0])
    for ident in (exact_dedup.identifier, lambda c: F.struct(F.lit(1).alias("h"), F.octet_length(c).alias("len"))):  # the second: ids that collide
        got = exact_dedup.exact_duplicates(docs, least=16, ident=ident).collect()
        assert len(got) == len(awkward)
        for r in got:
            text = lower(next(x[1] for x in awkward if x[0] == r["doc_id"]))
            assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (max(want[text]), len(want[text]), hashlib.sha256(text.encode()).hexdigest())
            assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_chunks_are_the_text(spark, awkward):
    df = frame(spark, awkward).where("text is not null")
    assert df.where(F.array_join(exact_dedup.chunks(F.col("text"), 16, 64), "") != F.col("text")).count() == 0


def totals_of(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}


def test_token_counts(spark, docs, awkward, nothing, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    signs = {"words@1": 1}
    assert rollup.apply("a", token_counts.counted(docs, signs))
    assert not rollup.apply("a", token_counts.counted(docs, signs))
    assert rollup.apply("b", token_counts.counted(docs.where("doc_id > 20").withColumn("sign", F.lit(-1)), signs))
    assert rollup.apply("empty", token_counts.counted(nothing, signs))
    n, tokens = Counter(), Counter()
    for r in awkward:
        if r[0] <= 20:
            n[r[3], r[2], "words@1"] += 1
            tokens[r[3], r[2], "words@1"] += len((r[1] or "").encode().split())
    want = {k: (n[k], tokens[k]) for k in n}
    assert totals_of(rollup) == want
    for _ in range(2):
        rollup.compact()
        assert totals_of(rollup) == want and rollup.committed() == {"a", "b", "empty"}
        assert not any(rollup.apply(i, token_counts.counted(docs, signs)) for i in ("a", "b", "empty"))
    with pytest.raises(ValueError):
        rollup.apply("../a", token_counts.counted(docs, signs))


def test_token_counts_crashes(spark, tmp_path, monkeypatch):
    """Cut off before the marker, inside it, and at each deletion of compact()."""
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    batch = lambda k: spark.createDataFrame([("s", "en", "words@1", 1, k)], token_counts._ROLLUP)

    def cut(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:
        m.setattr(rollup, "_create", cut)
        with pytest.raises(RuntimeError):
            rollup.apply("x", batch(100))
    assert rollup.totals().count() == 0
    (tmp_path / "r/commits").mkdir()
    (tmp_path / "r/commits/x").write_text("x")
    assert rollup.apply("x", batch(1)) and rollup.apply("y", batch(2))
    want = {("s", "en", "words@1"): (2, 3)}
    for stop in range(1, 7):
        done = []

        def delete(name, f=token_counts.Rollup._delete, stop=stop, done=done):
            done.append(name)
            if len(done) == stop:
                cut()
            f(rollup, name)

        with monkeypatch.context() as m:
            m.setattr(rollup, "_delete", delete)
            try:
                rollup.compact()
            except RuntimeError:
                pass
        assert totals_of(rollup) == want and not rollup.apply("x", batch(1)) and not rollup.apply("y", batch(2)), stop
        assert rollup.apply(f"z{stop}", batch(stop))
        want = {("s", "en", "words@1"): (2 + stop, 3 + stop * (stop + 1) // 2)}
        assert totals_of(rollup) == want


def test_token_counts_many_batches(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    one = pa.table({"source": ["s"], "lang": ["en"], "tokenizer": ["words@1"], "docs": pa.array([1], pa.int64()), "tokens": pa.array([3], pa.int64())})
    for i in range(1000):
        (tmp_path / f"r/data/f{i}").mkdir(parents=True)
        pq.write_table(one, tmp_path / f"r/data/f{i}/part.parquet")
        assert rollup._commit(f"batch-with-a-long-name-{i}", f"f{i}")
    assert totals_of(rollup) == {("s", "en", "words@1"): (1000, 3000)}
    rollup.compact()
    assert totals_of(rollup) == {("s", "en", "words@1"): (1000, 3000)} and len(rollup.committed()) == 1000
    assert not rollup.apply("batch-with-a-long-name-7", spark.createDataFrame([], token_counts._ROLLUP))


def test_token_counts_query(docs, awkward, nothing):
    from tokenizers import Tokenizer
    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = defaultdict(lambda: [0, 0])
    for r in awkward:
        text = r[1] or ""
        if r[1] is not None and len(text) < token_counts.SHORT:
            continue
        for name, k in (("byte_bpe_50k@1", len(t.encode(text, add_special_tokens=False).ids)), ("words@2", len(re.findall(r"[^\W_]+", text)))):
            want[r[3], r[2], name][0] += 1
            want[r[3], r[2], name][1] += k
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["docs"], r["tokens"]] for r in token_counts.maintained(docs).collect()}
    assert got == want
    assert token_counts.maintained(nothing).count() == 0


def test_pipeline(spark, awkward, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    frame(spark, awkward).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == len(awkward)
    sets = {r[0]: shingles(r[1]) for r in awkward}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == set(groups(sets, 75).values())
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:3] == ["doc_id", "start", "length"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert got.sort_values(key).reset_index(drop=True).astype(str).equals(want.sort_values(key).reset_index(drop=True).astype(str))


def test_quality_reads_whole_words():
    long = b"x" * 24
    word, *_ = quality.word_features([long + b"abczzz", long + b"abdzzz", long.upper() + b"ABCZZZ", b"a" * 70_000 + b" b", b"a" * 69_999 + b"c b"])
    assert word[0] != word[1] and word[0] == word[2] and word[3] != word[5] and word[4] == word[6]


def test_raking_ends_when_steady(spark):
    rows = [("a", "en", "list", 10), ("a", "fr", "list", 30), ("b", "en", "essay", 40), ("b", "fr", "list", 20)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.7, "b": 0.3}, "lang": {"en": 0.5, "fr": 0.5}, "topic": {"list": 0.8, "essay": 0.2}}
    factors, left = mixing.fit(cells, targets)
    got = {d: {} for d in mixing.DIMENSIONS}
    for s, lang, topic, n in rows:
        w = n * factors["source"][s] * factors["lang"][lang] * factors["topic"][topic]
        for d, k in zip(mixing.DIMENSIONS, (s, lang, topic), strict=True):
            got[d][k] = got[d].get(k, 0) + w / 100
    assert left < mixing.TOLERANCE
    assert all(abs(got[d][k] - share) < 1e-6 for d in targets for k, share in targets[d].items())
    # no weights meet these: all of a's tokens are French
    cells = spark.createDataFrame([("a", "fr", "list", 2), ("b", "fr", "list", 1), ("b", "en", "list", 1)], cells.schema)
    with pytest.warns(UserWarning, match="not met"):
        assert mixing.fit(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.9, "fr": 0.1}, "topic": {"list": 1.0}}, 4)[1] > 0.1

"""Divergence audits and license scans against brute force, on real rows and on rows with nulls, ties, repeats and odd texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strandline.llm import divergence, licenses
from tests.compare import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string"


def term_rows():
    rng = random.Random(3)
    pool = ["tide", "STONE", "über", "Ébb", "salt9sea", "a", "zz", "it's"]
    rows = [(i, " ".join(rng.choice(pool[: 3 + i % 6]) for _ in range(rng.randrange(1, 30))), rng.choice(["en", "de", None]), f"s{rng.randrange(9)}") for i in range(260)]
    rows += [(300, None, "en", None), (301, "", "", ""), (302, " \t", "fr", "s1"), (303, "rare words only", "fr", "s2"), (None, "tide " * 4000, "en", "hot"), (5, "tide stone", "en", "s0"), (5, "tide stone", "en", "s0")]
    return rows + [(400 + i, "tide tide stone", "en", "hot") for i in range(40)]


def brute_divergence(rows, least, top):
    docs = [((lang or ""), (source or ""), [m.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = sorted({t for d in mine for t in d[2] if sum(t in x[2] for x in mine) >= least})
        def shares(texts):
            n = {t: sum(x[2].count(t) for x in texts) for t in kept}
            return {t: 1 + 10**9 * (n[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}, n
        q, _ = shares(mine)
        each = {s: shares([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for s, (p, n) in each.items():
            pairs = [(-sum(abs(p[t] - o[t]) for t in kept), x.encode()) for x, (o, _) in each.items() if x != s]
            terms = [(q[t] - p[t], t.encode()) for t in kept if n[t] and p[t] > q[t]]
            out += [(lang, s, "pair", x.decode(), -v, i + 1) for i, (v, x) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", x.decode(), -v, i + 1) for i, (v, x) in enumerate(sorted(terms)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard,block,top", [(2, 1, 3), (3, 2, 50), (8192, 3, 2), (8192, 8, 50)])
def test_divergence(spark, shard, block, top):
    rows = term_rows()
    got = divergence.divergence(spark.createDataFrame(rows, DOCS).repartition(3), 30, top, shard, block)
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(rows, 30, top)


def test_divergence_empty_and_renamed(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).collect() == []
    odd = spark.createDataFrame(term_rows(), DOCS).withColumns({"term": F.lit(1), "n": F.lit("x"), "value": F.lit(0), "block": F.lit(2), "total": F.lit(3)})
    assert len(divergence.divergence(odd, 30, 2).collect()) == len(brute_divergence(term_rows(), 30, 2))


@pytest.mark.parametrize("players", range(1, 10))
def test_every_two_blocks_meet_once(spark, players):
    rows = spark.range(players).select(F.col("id").alias("me"), F.explode(divergence.schedule(F.lit(players).cast("bigint"), F.col("id"))).alias("m")).select("me", "m.host", "m.round").collect()
    assert sorted(tuple(sorted((r.me, r.host))) for r in rows) == [(a, b) for a in range(players) for b in range(a + 1, players)]
    assert len({(r.round, x) for r in rows for x in (r.me, r.host)}) == 2 * len(rows)  # one meeting a block and round


def test_shares_are_exact_beyond_64_bits():
    counts = divergence.np.array([0, 7, 10**12, 3 * 10**13], "i8")
    assert divergence.shares(counts, 10**14, 10**7).tolist() == [1 + 10**9 * (int(c) + 5) // (10**14 + 5 * 10**7) for c in counts]


@pytest.mark.parametrize("name", ["op11_systolic_audit"])
def test_sql(spark, name):
    assert spark_rows(__spark_entry__.queries()[name](spark, SF)) == sql_rows(connect(SF), __spark_entry__.oracle_sql()[name])


NOTICES = [t[2] for t in licenses.TEMPLATES]


def license_rows():
    rng = random.Random(11)
    filler = ["tide", "the", "of", "software", "license", "this", "is", "under", "general", "public", "Über", "stone", "2", "3", "version"]
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Released under the MIT License."), (5, "CC BY-NC 4.0, cc by nc; under the  mit\nlicense"), (6, "Licensed under the Apache License, Version 2.0."), (6, "under the MIT License under the MIT license"), (None, "the mitigated license")]
    for i in range(160):
        words = rng.choice(NOTICES).split()
        for _ in range(rng.randrange(len(words) // 3)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], [rng.choice(filler)], [words[k], rng.choice(filler)]])
        rows.append((100 + i, f"{prose(rng.randrange(60))}\n{' '.join(words)} {prose(rng.randrange(60))}" if i % 4 else " ".join(words[: len(words) * 9 // 10])))
    rows.append((999, prose(20_000) + " " + " \n".join(NOTICES) + " " + prose(20_000)))
    return rows


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_licenses(text, threshold):
    words = brute_words(text)
    base = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    spans = []
    for k, (label, family, notice) in enumerate(licenses.TEMPLATES):
        have, width = set(brute_words(notice)), min(int(len(brute_words(notice)) * licenses.WIDEN), len(words))
        run = None
        for s in range(len(words) - width + 1):
            n = len(have & set(words[s : s + width]))
            if n * 1000 < round(threshold * 1000) * len(have):
                continue
            if run and s <= run[2]:
                run[2], run[3] = s + width, max(n, run[3])
            else:
                run = [k, s, s + width, n, family, label, len(have)]
                spans.append(run)
    kept = [x for x in spans if not any(x[4] == y[4] and x[1] < y[2] and y[1] < x[2] and (y[3], -y[6]) > (x[3], -x[6]) for y in spans)]
    labels = {x[1] for x in base} | {x[5] for x in kept}
    score = 1.0 if base else max((x[3] / x[6] for x in kept), default=0.0)
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x[1] for x in base})), ",".join(sorted(labels)), score


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_licenses(spark, threshold):
    rows = license_rows()
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), threshold=threshold).drop("blocks").collect()
    want = [(d, *brute_licenses(t, threshold)) for d, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({r.labels for r in got}) > 10


def test_license_spans_and_families(spark):
    text = "Intro words here. This work is licensed under the GNU General Public License, version 3. The end."
    row = licenses.licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.labels == "gpl-3" and row.base_labels == "" and row.score == 1.0 and row.n_base == 0
    assert all(text.split()[3] == "This" and b.start <= 3 and b.stop >= 15 for b in row.blocks)


def test_licenses_empty_and_given_tables(spark):
    assert licenses.licenses(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    odd = spark.createDataFrame(license_rows()[:8], "doc_id bigint, text string").withColumns({"labels": F.lit(1), "score": F.lit("x"), "word": F.lit(0)})
    assert len(licenses.licenses(odd).collect()) == 8
    real = spark.read.parquet(f"{SF}/documents.parquet")
    got = __spark_entry__.queries()["op13_license_join"](spark, SF).drop("blocks").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *brute_licenses(r.text, licenses.THRESHOLD)) for r in real.collect())

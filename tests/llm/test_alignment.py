"""Alignment of two tokenizers against whole texts tokenized directly."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strandline.llm import alignment

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    from strandline.llm.packing import enumerate_bytes

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    signs = {c: b for b, c in enumerate_bytes()}

    def piece(i):
        name = two.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if len(name) == 6 and name.startswith("<0x") else name.replace("▁", " ").encode()

    made = []
    for doc, text in rows:
        groups = []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            spelt = [[bytes(signs[c] for c in one.id_to_token(i)) for i in a], [piece(i) for i in b]]
            if b"".join(spelt[0]) == b"".join(spelt[1]) == (" " + text).encode():
                ends = []
                for side in spelt:
                    at, found = 0, []
                    for t in side:
                        at += len(t)
                        found.append(at)
                    ends.append(found)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups = [([i for i, e in zip(a, ends[0]) if lo < e <= hi], [i for i, e in zip(b, ends[1]) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        made.append((doc, groups))
    counts, firsts = Counter(), defaultdict(int)
    for _, groups in made:
        counts.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    for (x, _), n in counts.items():
        firsts[x] = max(firsts[x], n)
    out = []
    for doc, groups in made:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        sizes = sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links)
        out.append((doc, *sizes, sum(counts[p] == firsts[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def odd_rows():
    return [
        (1, None), (2, ""), (3, " "), (4, "   "), (5, "one"), (6, "one two  three\n four\t five   six "), (7, "U+2581 is ▁ here"), (8, "\x00 odd \x1f \x85 x"), (8, "\x00 odd \x1f \x85 x"),
        (9, "漢字とかな \U0001f600\U0001f600 été naïve"), (10, "<|endoftext|> <s> </s> <unk> <0x41>"), (11, "a" * 3000 + " " + "b c " * 500), (None, "don't can't it's\r\n\r\n  def f(x):\n    return x+1"),
        (12, "\n\nlead and trail\n\n"), (13, "x  y   z　 w"), (14, " ́ combining é ﻿bom"),
    ]


@pytest.mark.parametrize("size", [1, 200, 16 << 20])
def test_odd_texts(spark, size):
    docs = spark.createDataFrame(odd_rows(), "doc_id bigint, text string").repartition(2).withColumns({"block": F.lit(1), "pair": F.lit("x"), "n": F.lit(2)})
    got = alignment.aligned_documents(docs, A, B, size, with_groups=True).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted(brute(odd_rows()), key=repr)
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in got)


def test_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = __spark_entry__.queries()["op12_relational_alignment"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_empty(spark):
    assert alignment.aligned_documents(spark.createDataFrame([], "doc_id bigint, text string"), A, B).collect() == []


def test_alignment_deals_segments_once(spark):
    rows = spark.createDataFrame([("one",), ("two three",), ("▁",), ("",)], "segment string").distinct()
    with alignment.dealt_by_part_of_keys(spark):
        made = alignment.aligned(rows, alignment.Sides(spark, A, B))
        assert {r.segment for r in made.collect()} == {"one", "two three", ""}
        plan = made._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial")[0]
    dealt = [x for x in final.splitlines() if "Exchange hash" in x and "Reused" not in x]
    assert all("hashpartitioning(segment#" in x and "end#" not in x and "at#" not in x for x in dealt)
    assert sum("REPARTITION_BY_COL" in x for x in dealt) == 1 and len(dealt) <= 4, dealt


def test_tokens_are_exploded_once_a_side(spark):
    rows = spark.createDataFrame([("one",), ("two three",)], "segment string").distinct()
    with alignment.dealt_by_part_of_keys(spark):
        plan = alignment.aligned(rows, alignment.Sides(spark, A, B))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 2, plan


def test_what_was_dealt_is_deleted_and_settings_come_back(spark, monkeypatch):
    names = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffle.partitions"
    before, seen, real = [spark.conf.get(n) for n in names], {}, alignment.stored

    def stored(df, name, *rest):
        seen[name] = [spark.conf.get(n) for n in names]
        return real(df, name, *rest)

    monkeypatch.setattr(alignment, "stored", stored)
    got = alignment.aligned_documents(spark.createDataFrame(odd_rows(), "doc_id bigint, text string"), A, B).collect()
    assert len(got) == len(odd_rows()) and [spark.conf.get(n) for n in names] == before
    assert seen["lines"] == ["true", str(alignment.FINER * int(before[1]))] and seen["bound"] == ["true", before[1]]

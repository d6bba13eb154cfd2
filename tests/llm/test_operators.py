"""Operators against brute force, on a real sample and on rows with nulls, ties, repeats, blanks and long texts."""

import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from strandline.llm import common, components, cotraining, mixing, mpeg, ngram_join, packing, ppm, quality, quotes, repeats, warc
from tests.compare import connect, spark_rows, sql_rows
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def messy_rows():
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["the", "tide", "Came", "in", "über", "stones,", "and", "left."]) + str(rng.randrange(40)) for _ in range(n))
    long, passage = prose(3000), prose(120)
    near = prose(200).split()
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, long), (6, long), (7, long), (None, "no id here " * 30), (None, None), (8, "a" * 1500)]
    rows += [(10 + i, prose(40) + " " + passage + " " + prose(40)) for i in range(6)]
    for i in range(6):
        words = list(near)
        words[i * 3] = f"changed{i}"
        rows.append((20 + i, " ".join(words)))
    rows += [(30, "Same\nline one two.\nSame\nline one two.\n"), (31, "x | y | z | w"), (32, "\x00 odd \x1f bytes é 😀 <|endoftext|> tail   spaces \n  "), (33, "one TWO"), (34, passage[:399]), (35, passage[:400])]
    return [(d, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(row):
    return repr(row)


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_sql(spark, name):
    assert spark_rows(__spark_entry__.queries()[name](spark, SF)) == sql_rows(connect(SF), __spark_entry__.oracle_sql()[name])


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("which", ["messy", "real"])
def test_jaccard(request, which, n, percent):
    df = request.getfixturevalue(which)
    got = [tuple(r) for r in ngram_join.jaccard_components(df.select("doc_id", "text"), n, percent).drop("text_md5").collect()]
    assert sorted(got, key=key) == sorted(brute.component_ids(pairs_of(df), n, percent), key=key)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.sampled_from([80, 90]))
def test_linked_sets_share_a_group(n, seed, percent):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype("u8"))
    out, into = rng.integers(0, max(1, n // 9) + 1, 2)
    b = np.unique(np.concatenate([a[out:], rng.integers(0, 2**63, into).astype("u8")]))
    both = len(np.intersect1d(a, b))
    if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
        assert len(np.intersect1d(ngram_join.group_keys(a, percent), ngram_join.group_keys(b, percent)))


def test_count_tree_passes_no_link_by():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300).astype("u8")
    sets = [np.unique(np.concatenate([base[rng.random(300) < keep], rng.integers(0, 2**63, 20).astype("u8")])) for keep in rng.random(120)]
    label = ngram_join.links(sets, 60)
    docs = [frozenset(s.tolist()) for s in sets]
    for i in range(len(docs)):
        for j in range(i):
            both = len(docs[i] & docs[j])
            if 100 * both >= 60 * (len(docs[i]) + len(docs[j]) - both):
                assert label[i] == label[j]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [40, 41]


@pytest.mark.parametrize("which", ["messy", "real"])
def test_repeats(request, spark, which, tmp_path):
    df = request.getfixturevalue(which)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in repeats.op2_radix_repeats(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(brute.without_repeats(pairs_of(df)), key=key)


def test_repeated_passages_of_over_50_words_go(spark):
    word = lambda kind, n: " ".join(f"{kind}{i:04d}" for i in range(n))
    passage, shorter = word("p", 55), word("q", 50)
    texts = [f"{word('a', 60)}\n{passage}\n{word('b', 60)}", f"{word('c', 30)} {passage} {word('d', 30)}", f"{word('e', 40)}_{shorter}_{word('f', 9)}", f"{shorter}|", word("g", 200), None]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.text for r in repeats.stage(spark, docs, "").collect()}
    assert "p0030" not in got[0] + got[1] and got[0].startswith(word("a", 60)) and got[1].endswith(word("d", 30))
    assert [got[i] for i in range(2, 6)] == texts[2:]
    wanted = brute.without_repeats(list(enumerate(texts)), repeats.STAGE_WIDTH, repeats.STAGE_WORDS)
    assert [len((got[d] or "").encode()) for d, *_ in wanted] == [n - gone for _, n, gone, _, _ in wanted]


def test_digit_passes_on_shared_pieces(spark):
    """Short widths, so that many ranges end inside passages that others share in part."""
    rng = random.Random(8)
    pieces = ["".join(rng.choice("abé ") for _ in range(rng.randrange(10, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pieces)[rng.randrange(8) :] if rng.random() < 0.7 else "".join(rng.choice("xyz") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(7)))) for i in range(150)]
    rows += [(200, "ab" * 40), (201, rows[7][1]), (202, "a" * 30 + "b"), (203, "a" * 29)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS).repartition(5)
    for width, digit in ((24, 8), (60, 16)):
        cut = {bytes(r.text_id): (r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removals(docs.select("doc_id", "text"), width, digit).collect()}
        for (_, t), (_, _, gone, runs, sha) in zip(rows, brute.without_repeats(rows, width), strict=True):
            assert cut.get(hashlib.md5(t.encode()).digest(), (0, 0, hashlib.sha256(t.encode()).hexdigest())) == (gone, runs, sha)


def test_long_texts_are_cut_into_segments(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 103, 9000).astype("u1")
    whole = repeats.anchors(data, np.array([0, len(data)]), 400, 128)
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    parts = repeats.long_anchors(data, 400, 128)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]
    suffixes = sorted(int(a) - t for a, near, far in zip(whole[0], whole[2], whole[3], strict=True) for t in range(near, far + 1))
    assert suffixes == list(range(len(data) - 400 + 1))  # every suffix has one anchor


def check_packing(docs, rows, path):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    want = sorted(np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in docs)
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault((r.sequence_id, r.offset), r)
        sequences.setdefault(r.sequence_id, []).append(r)
        ids = np.array(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *[r.length for r in s]])[:-1].tolist() and sum(r.length for r in s) <= 2048
    assert sum(r.length for r in rows) == sum(len(w) // 4 for w in want)
    return want


@pytest.mark.parametrize("which", ["messy", "real"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    path, docs = packing.tokenizer_path(), pairs_of(df)
    rows = packing.packed(df, path).collect()
    want = check_packing(docs, rows, path)
    if which == "real":
        by_doc = {}
        for r in rows:
            by_doc.setdefault(r.doc_id, []).append(r)
        got = []
        for pieces in by_doc.values():
            pieces.sort(key=lambda r: r.start)
            assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
            got.append(np.array([i for p in pieces for i in p.ids], "<u4").tobytes())
        assert sorted(got) == want
        used = {}
        for r in rows:
            used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
        assert sum(2048 - u for u in used.values()) < 0.05 * sum(used.values())
        assert all(len(p) == -(-p[0].doc_tokens // 2048) for p in by_doc.values())  # no remainder is cut


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_pack_cuts_nothing_and_raises_the_count(sizes):
    windows = packing.pack(sizes, 64)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in w) <= 64 for w in windows)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 2047), min_size=1, max_size=300))
def test_the_count_rises_at_every_excess_and_loads_are_near_equal(sizes):
    tried, plain = [], packing.differencing

    def watched(sizes, k):
        windows = plain(sizes, k)
        tried.append((k, max(sum(sizes[i] for i in w) for w in windows)))
        return windows

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "differencing", watched)
        windows = packing.pack(sizes, 2048)
    assert tried[0][0] == -(-sum(sizes) // 2048)
    assert all(over > 2048 and k < after for (k, over), (after, _) in zip(tried, tried[1:], strict=False)) and tried[-1][1] <= 2048
    assert len(windows) <= tried[-1][0] <= len(sizes)


def test_loads_of_real_remainders_are_near_equal():
    rng = random.Random(5)
    sizes = [rng.randrange(1, 2048) if rng.random() < 0.3 else rng.randrange(1, 900) for _ in range(1000)]
    loads = [sum(sizes[i] for i in w) for w in packing.pack(sizes, 2048)]
    assert len(loads) > -(-sum(sizes) // 2048)  # it did rise
    assert max(loads) <= 2048 and min(loads) > 0.88 * 2048 and sum(loads) > 0.94 * 2048 * len(loads)


def test_pack_of_three_that_pairs_exceed():
    assert len(packing.pack([40, 40, 40], 64)) == 3
    assert len(packing.pack([2048] * 5, 2048)) == 5 and len(packing.pack([1024] * 7, 2048)) == 4


def test_quality_verdicts(messy):
    got = {(r.doc_id, r.text): r for r in quality.quality_rules(messy.withColumn("n_words", F.lit("clash"))).collect()}
    blank = got[(1, None)]
    assert (blank.n_words, blank.word_chars, blank.n_symbols, blank.kept) == (0, 0, 0, False)
    assert got[(30, "Same\nline one two.\nSame\nline one two.\n")].n_dup_lines == 2
    assert got[(31, "x | y | z | w")].clean_text == ""


def test_quality_lines_by_hand(spark):
    """Verdicts written down by hand, not taken from the patterns."""
    stays = ["The tide came in and left stones.", "Is that so?", '"It is," she said.', "", "La mer monte.", "A | B in a sentence."]
    goes = ["a heading", "Home | News | About | Help.", "Alle Rechte vorbehalten.", "CONDITIONS D’UTILISATION.", "Haga clic AQUÍ.", "Subscribe now!", "!!! *** !!! ***.", "Mentions légales."]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*stays, *goes])], "doc_id bigint, text string")
    got = {r.doc_id: r.n_lines_removed for r in quality.clean_lines(docs).collect()}
    assert [got[i] for i in range(len(got))] == [0] * len(stays) + [1] * len(goes)
    sql = f"WITH {quality.BASE_SQL.replace('@docs', 'lines')} SELECT doc_id, n_lines_removed FROM judged ORDER BY 1"
    con = connect(SF)
    con.execute("CREATE TABLE lines (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO lines VALUES (?, ?)", list(enumerate([*stays, *goes])))
    assert con.execute(sql).fetchall() == sorted(got.items())


def test_mixing_keeps_other_columns(messy):
    clash = messy.withColumns({c: F.lit(c) for c in ("copies", "cut", "_h", "_s", "_salt", "_source", "size", "target")})
    out = mixing.mixed(clash)
    assert set(out.columns) == set(clash.columns) | set(mixing.MIXED) and len(out.columns) == len(clash.columns) + 2
    assert {(r.copies, r.cut, r._h, r._salt) for r in out.collect()} == {("copies", "cut", "_h", "_salt")}


def test_mixing(messy, real):
    for df in (messy, real):
        out = mixing.mixed(df).collect()
        assert len(out) == df.count() and all(0 <= r.times <= 3 for r in out)
        sources = {}
        for r in out:
            s = sources.setdefault(r.source, [r.target, 0, 0, 0])
            s[1], s[2], s[3] = s[1] + r["size"] * r.times, max(s[2], r["size"]), s[3] + r["size"]
        assert sum(s[0] for s in sources.values()) == pytest.approx(sum(s[3] for s in sources.values()))
        assert all(abs(s[1] - s[0]) <= s[2] and s[0] <= 3 * s[3] for s in sources.values())


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_mpeg_round_trip(data):
    payload = data.ljust(-(-max(len(data), 1) // 64) * 64, b"\0")
    media = mpeg.encode(payload, len(data))
    back, found = mpeg.decode(media)
    assert back == payload and found["bad"] == found["lost"] == 0 and found["fields"]["text-bytes"] == str(len(data))
    table = found["table"]
    assert (table["frames"], table["bytes"], len(table["points"])) == (len(found["offsets"]), len(media) - mpeg.read_tag(media)[1], 100)
    assert found["samples"] == 1152 * len(found["offsets"]) and found["rate"] == 48000


MARKS = [b"TAG", b"ID3\x04\0\0", b"Xing", b"Info", b"VBRI", b"\xff\xfa\xe4\xc0", b"\xff\xfb\x94\xc0", b"LAME"]


@pytest.mark.parametrize("mark", MARKS)
def test_mpeg_payloads_with_marks(mark):
    """A mark at every distance from both ends of payloads around the sizes of frames is payload."""
    for size in (64, 128, 192, 320, 896, 960, 1024):
        plain = bytes(range(1, 250)) * 5
        for at in range(size - len(mark) + 1):
            payload = plain[:at] + mark + plain[at + len(mark) : size]
            back, found = mpeg.decode(mpeg.encode(payload, size))
            assert back == payload and found["lost"] == 0 and found["bad"] == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*MARKS, b"\0", b"x" * 17, b"\xff"]), max_size=120))
def test_mpeg_payloads_of_marks(parts):
    payload = b"".join(parts).ljust(64, b"\0")
    assert mpeg.decode(mpeg.encode(payload, len(payload)))[0] == payload


def test_mpeg_short_streams_are_errors():
    media = mpeg.encode(bytes(range(256)) * 20, 5120)
    for cut in (1, 128, 960, 3000):
        with pytest.raises(ValueError, match="holds"):
            mpeg.decode(media[:-cut])
    assert mpeg.decode(media + b"TAG" + b"a" * 125)[1]["fields"]["title"] == "a" * 30


def test_mpeg_damage():
    media = mpeg.encode(bytes(range(256)) * 40, 10240)
    whole = mpeg.parse(media)
    broken = bytearray(media)
    broken[whole["offsets"][3]] = 0
    found = mpeg.parse(bytes(broken))
    assert found["lost"] >= 1 and found["offsets"][-1] == whole["offsets"][-1]
    broken = bytearray(media)
    broken[whole["offsets"][2] + 8] ^= 1
    assert mpeg.parse(bytes(broken))["bad"] == 1


def plain_crc(bits):
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 ^ bit else 0)
    return crc


def frames_of(version, layer, index, rate_index, size, side_bits, n=6, mode=3, start=b""):
    """n frames with checksums; the first one holds `start` behind its side information."""
    out, b1 = [], 0xE0 | version << 3 | (4 - layer) << 1
    side = bytes(range(1, 1 + -(-side_bits // 8)))
    head = bytes((0xFF, b1, index << 4 | rate_index << 2, mode << 6))
    bits = [b >> k & 1 for b in head[2:] for k in range(7, -1, -1)] + [b >> k & 1 for b in side for k in range(7, -1, -1)][:side_bits]
    for i in range(n):
        body = side + (start if i == 0 else b"\x55")
        out.append((head + struct.pack(">H", plain_crc(bits)) + body).ljust(size, b"\0"))
    return out


# version field, layer, bit rate index, rate index, frame bytes, protected side bits; samples a frame and rate
STREAMS = [
    (3, 3, 9, 0, 144 * 128000 // 44100, 17 * 8, 1152, 44100),
    (2, 3, 8, 1, 72 * 64000 // 24000, 9 * 8, 576, 24000),
    (0, 3, 4, 2, 72 * 32000 // 8000, 9 * 8, 576, 8000),
    (3, 1, 5, 2, 12 * 160000 // 32000 * 4, 128, 384, 32000),
    (2, 1, 5, 0, 12 * 80000 // 22050 * 4, 128, 384, 22050),
    (3, 2, 10, 1, 144 * 192000 // 48000, 0, 1152, 48000),
    (2, 2, 10, 1, 144 * 96000 // 24000, 0, 1152, 24000),
]


@pytest.mark.parametrize("stream", STREAMS)
def test_mpeg_versions_and_layers(stream):
    *kind, samples, rate = stream
    frames = frames_of(*kind)
    found = mpeg.parse(b"".join(frames))
    assert found["offsets"] == [i * len(frames[0]) for i in range(6)] and (found["samples"], found["rate"]) == (6 * samples, rate)
    assert (found["bad"], found["lost"], found["table"]) == (0, 0, None)
    broken = bytearray(b"".join([*frames[:2], b"\xff\xfbjunk", *frames[2:]]))
    broken[2 * len(frames[0]) + 6 + 7] ^= 0x40
    found = mpeg.parse(bytes(broken))
    assert len(found["offsets"]) == 5 and found["lost"] == 1 and found["bad"] == (stream[1] != 2)


def test_mpeg_tables():
    frames = frames_of(2, 3, 8, 1, 192, 72, start=b"Info" + struct.pack(">III", 7, 5, 960) + bytes(range(100)) + b"LAME3.100".ljust(21, b"\0") + bytes((0x24, 0x01, 0x90)))
    found = mpeg.parse(b"".join(frames))
    assert found["table"] == {"name": "Info", "frames": 5, "bytes": 960, "points": list(range(100)), "delay": 0x240, "padding": 0x190}
    assert found["offsets"] == [192 * i for i in range(1, 6)] and found["samples"] == 5 * 576 - 0x240 - 0x190
    vbri = struct.pack(">4sHHHIIHHHH", b"VBRI", 1, 576, 75, 2085, 5, 3, 2, 2, 2) + struct.pack(">HHH", 10, 20, 30)
    first = bytearray(frames_of(3, 3, 9, 0, 417, 136)[0])
    first[36 : 36 + len(vbri)] = vbri
    found = mpeg.parse(bytes(first) + b"".join(frames_of(3, 3, 9, 0, 417, 136)[:5]))
    assert found["table"] == {"name": "VBRI", "frames": 5, "bytes": 2085, "points": [20, 60, 120], "delay": 576, "padding": 0}
    assert len(found["offsets"]) == 5 and found["samples"] == 5 * 1152 - 576


def test_mpeg_tags():
    frames = b"".join(frames_of(3, 3, 9, 0, 417, 136))
    seven = lambda n: bytes(n >> k & 127 for k in (21, 14, 7, 0))
    title = b"\1\xff\xfe" + "Tide é".encode("utf-16-le")
    body = b"TIT2" + struct.pack(">I", len(title)) + b"\0\0" + title + b"TPE1\0\0\0\4\0\0\0Ann" + bytes(20)
    stuffed = body.replace(b"\xff", b"\xff\0")
    third = b"ID3\3\0\x80" + seven(len(stuffed)) + stuffed
    second = b"ID3\2\0\0" + seven(11) + b"TT2\0\0\5\0Sea\0"
    fourth = b"ID3\4\0\x10" + seven(20) + b"TXXX" + seven(10) + b"\0\0\3key\0value" + b"3DI\4\0\x10" + seven(20)
    tail = (b"TAG" + b"Old".ljust(30, b"\0") + bytes(60) + b"1999" + b"note".ljust(28, b"\0") + b"\0\7\1").ljust(128, b"\0")
    for lead, want in ((third, {"TIT2": "Tide é", "TPE1": "Ann"}), (second, {"TT2": "Sea"}), (fourth, {"key": "value"}), (third + fourth, {"TIT2": "Tide é", "TPE1": "Ann", "key": "value"})):
        found = mpeg.parse(lead + frames + tail)
        assert found["fields"] == want | {"title": "Old", "year": "1999", "comment": "note", "track": "7"}
        assert found["offsets"] == [len(lead) + 417 * i for i in range(6)] and found["lost"] == 0
    assert mpeg.parse(b"")["offsets"] == [] and mpeg.parse(b"no audio " * 9)["samples"] == 0


def test_mpeg_query(spark, messy, empty):
    long = spark.createDataFrame([(77, "lang é " * 300_000, "en", "s", 1)], DOCS)
    docs = messy.unionByName(long)
    media = {repr((r.doc_id, len(r.media), hashlib.sha256(r.media).hexdigest())) for r in mpeg.as_media(docs).collect()}
    got = mpeg.digests(mpeg.as_media(docs.withColumns({"media": F.lit(1), "n_bytes": F.lit("clash")}))).collect()
    want = []
    for d, t in pairs_of(docs):
        raw = (t or "").encode()
        payload = raw.ljust(-(-max(len(raw), 1) // 64) * 64, b"\0")
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=key) == sorted(want, key=key)
    assert {repr((r.doc_id, r.media_bytes, r.media_sha256)) for r in got} == media
    room = 960 - 23
    for r in got:
        assert len(r.frame_offsets) == -(-r.payload_bytes // room) and r.samples == 1152 * len(r.frame_offsets) and r.sample_rate == 48000
        assert [b - a for a, b in zip(r.frame_offsets[:-1], r.frame_offsets[1:], strict=True)] == [960] * (len(r.frame_offsets) - 1)
        assert f"seek_crc32={zlib.crc32(np.array(r.frame_offsets, '<u8').tobytes()):08x}" in r.feature and "crc_errors=0 resync=0" in r.feature
    by_payload = {}
    for r in got:
        by_payload.setdefault((r.n_bytes, r.payload_sha256), set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_payload.values())  # equal texts, equal values
    assert mpeg.digests(mpeg.as_media(empty)).count() == 0


MESSAGES = "conv_id bigint, turn bigint, role string, text string"


def by_sql(rows):
    con = connect(SF)
    con.execute("CREATE TABLE messages (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", rows)
    return sql_rows(con, quotes.SQL.replace("@rows", "messages"))


def by_spark(spark, rows):
    return spark_rows(quotes.linked(spark.createDataFrame(rows, MESSAGES).repartition(3)).select("conv_id", "turn", "role", *quotes.RESULTS))


def test_quotes(spark, empty):
    rows = [
        (1, 0, "The tide came in.\nIt left stones."),
        (1, 1, "On Monday A wrote:\n> The  TIDE came in.\n> It left stones.\nI saw them too, there."),
        (1, 3, "B wrote this:\n> > It left stones.\n> I saw them too, there.\nWhere?"),
        (2, 0, "> I saw  THEM too, there.\nSo did I."),
        (2, 1, None),
        (None, 3, "> The tide came in.\nx"),
        (3, None, ""),
        (4, 0, "> never said by anyone\nplain"),
        (4, 7, "> said later\nx"),
        (4, 9, "said later"),
    ]
    rows = [(c, t, "user", x) for c, t, x in rows]
    got = {(r.conv_id, r.turn): r for r in quotes.linked(spark.createDataFrame(rows, MESSAGES)).collect()}
    to = lambda c, t: (got[(c, t)].reply_conv, got[(c, t)].reply_turn)
    assert len(got) == len(rows)
    assert got[(1, 1)].body == "I saw them too, there." and to(1, 1) == (1, 0)
    assert got[(1, 3)].max_level == 2 and got[(1, 3)].n_quotes == 2 and to(1, 3) == (1, 1)
    assert got[(2, 0)].body == "So did I." and to(2, 0) == (1, 1)
    assert got[(2, 1)].body == "" and to(2, 1) == (2, 0)
    assert to(4, 0) == (None, None) and got[(4, 0)].n_linked == 0 and to(4, 7) == (4, 0) and to(4, 9) == (4, 7)
    r = got[(2, 1)]
    assert (r.root_conv, r.root_turn, r.depth, r.position) == (1, 0, 3, 1)
    assert (got[(4, 9)].depth, got[(4, 9)].position) == (2, 2)
    assert [got[k].depth for k in ((None, 3), (3, None))] == [None, None]
    assert by_spark(spark, rows) == by_sql(rows)


def test_short_quotes_stay_in_their_conversation(spark):
    rows = [
        (1, 0, "Yes"),
        (1, 1, "The boat left the harbour at six.\nNobody was on the quay then."),
        (1, 2, "one two three four"),
        (7, 0, "Shall we go?"),
        (7, 1, "> Yes\nWhy?"),
        (7, 2, "> The boat left the harbour at six.\n> Nobody else came.\nReally?"),  # its first line is said elsewhere, the passage isn't
        (7, 3, "> one two three four\n?"),
        (7, 4, "> Shall we go?\nYes"),
        (7, 5, "> The boat left the harbour at six.\n> Nobody was on the quay then.\nSo?"),
        (7, 6, "> Yes\nGood."),
    ]
    rows = [(c, t, "user", x) for c, t, x in rows]
    messages = spark.createDataFrame(rows, MESSAGES)
    found = lambda **how: {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotes.linked(messages, **how).collect()}
    got = found()
    assert [got[(7, t)] for t in range(1, 7)] == [(7, 0), (7, 1), (7, 2), (7, 0), (1, 1), (7, 4)]
    assert found(outside=4)[(7, 3)] == (1, 2)
    assert by_spark(spark, rows) == by_sql(rows)


def threads_of(rng, conversations):
    """Messages that quote passages, single lines and nested quotes of any message, earlier or later, also of each other."""
    line = lambda: " ".join(rng.choice(["tide", "Stone", "über", "net", "a>b", ""]) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 4)))
    own = {(c, t): [line() for _ in range(rng.randrange(4))] for c in range(conversations) for t in sorted(rng.sample(range(150), rng.randrange(1, 9)))}
    quote = lambda x: ("> " if rng.random() < 0.8 else ">") + x
    text = {k: list(v) for k, v in own.items()}
    for _ in range(2):
        for k in own:
            for other in rng.sample(list(own), rng.randrange(3)):
                part = [quote(x) for x in text[other][: rng.randrange(1, 5)]]
                at = rng.randrange(len(text[k]) + 1)
                text[k][at:at] = (["On day 3 X wrote:"] if rng.random() < 0.4 else []) + part
    rows = [(c, t, "user", rng.choice(["\n", "\n", "\r\n"]).join(x)) for (c, t), x in text.items()]
    return rows + rng.sample(rows, 3) + [(0, 0, "user", "> tide1\nsecond row of a turn"), (None, 2, None, "> x"), (5, None, "user", None)]


def test_random_threads_against_sql(spark):
    rows = threads_of(random.Random(11), 300)
    got, want = by_spark(spark, rows), by_sql(rows)
    assert got == want
    names = {n: i for i, n in enumerate(got[0])}
    at = {(r[names["conv_id"]], r[names["turn"]]): r for r in got[1]}
    linked = 0
    for k, r in at.items():
        up = (r[names["reply_conv"]], r[names["reply_turn"]])
        if up != (None, None):
            assert up in at and tuple(map(int, up)) < tuple(map(int, k))  # replies exist and point back, so there are no cycles
            assert int(r[names["depth"]]) == int(at[up][names["depth"]]) + 1
        linked += int(r[names["n_linked"]])
    assert linked > 200
    assert any(r[names["reply_conv"]] not in (None, r[names["conv_id"]]) for r in at.values())


def test_quotes_keep_columns_and_long_conversations(spark):
    rows = [(1, t, "user", f"> line {t - 3}\nline {t}") for t in range(0, 400, 2)]
    docs = spark.createDataFrame(rows, MESSAGES).withColumns({c: F.lit(c) for c in ("_id", "_runs", "_lines", "_best", "_conv", "body")})
    got = quotes.linked(docs).collect()
    assert set(docs.columns) <= set(got[0].asDict()) and all(r._id == "_id" and r._conv == "_conv" for r in got)
    assert sorted((r.position, r.depth) for r in got) == [(i, i) for i in range(200)]
    assert quotes.linked(spark.createDataFrame([(1, 0, "u", "x" * 300_000 + "\n> " + "y " * 100_000)], MESSAGES)).first().n_quotes == 1


@pytest.mark.parametrize("which", ["messy", "real"])
def test_ppm(request, which):
    df = request.getfixturevalue(which)
    docs = pairs_of(df)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.held_out, r.n_known, r.train_tokens, round(r.base_score, 3), round(r.score, 2)) for r in ppm.ppm_scores(df.select("doc_id", "text"), 1 << 16).collect()))
    want = sorted((d is None, d or 0, b[1], b[0], b[2], b[3], b[4], s) for (d, _), b, s in zip(docs, brute.base_scores(docs), brute.ppm_scores(docs, ppm.ORDER), strict=True))
    for g, w in zip(got, want, strict=True):
        assert g[:6] == w[:6] and g[6] == pytest.approx(w[6], abs=0.01) and g[7] == pytest.approx(w[7], rel=1e-4, abs=0.05)


def two_views(n, labelled):
    """Documents whose words and whose source both say something of their quality, with the truth, few labels and messy rows."""
    rng = random.Random(3)
    rows, truth = [], []
    for i in range(n):
        good = rng.random() < 0.5
        known = rng.random() < 0.86
        words = [f"{'fine' if good == (rng.random() < 0.68) else 'poor'}{rng.randrange(400)}" for _ in range(14)] + [f"w{rng.randrange(300)}" for _ in range(10)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", f"s{rng.randrange(150) + 150 * (good == known)}", 200))
        truth.append((i, int(good)))
    labels = [(d, q, 0) for d, q in truth if d % (n // labelled) == 0]
    return rows, dict(truth), labels


def test_cotraining_teaches_both_ways(spark):
    rows, truth, labels = two_views(5000, 500)
    docs, given = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    every = common.stored(cotraining.labelled(docs, given), "t")
    prior = cotraining.prior_of(every)
    known = {d for d, *_ in labels}

    def right(views, odds):
        got = cotraining.scored(every, views, prior).collect()
        return sum((odds(r) >= 0) == bool(truth[r.doc_id]) for r in got if r.doc_id not in known) / (len(got) - len(known))

    alone, _ = cotraining.trained(every, prior, 1)
    views, taught = cotraining.trained(every, prior, 3)
    for turn in (1, 2):
        assert all(min(taught[turn][v][c] - taught[0][v][c] for c in range(2)) > 0 for v in range(2)), taught  # each view was given labels of both kinds
    both = right(views, lambda r: r.text_odds + r.meta_odds)
    assert both > max(right(alone, lambda r: r.text_odds), right(alone, lambda r: r.meta_odds))
    assert both > max(right(views, lambda r: r.text_odds), right(views, lambda r: r.meta_odds))
    assert both > right(alone, lambda r: r.text_odds + r.meta_odds) + 0.01
    plain = [((np.frombuffer(r.text_bins, "<u2").tolist(), np.frombuffer(r.meta_bins, "<u2").tolist()), r.y, r.held) for r in every.collect()]
    want_taught, want = brute.cotrained(plain, prior, 3, cotraining.SHARE)
    assert taught == want_taught
    got = sorted((round(r.text_odds, 6), round(r.meta_odds, 6)) for r in cotraining.scored(every, views, prior).collect())
    assert got == sorted((round(a, 6), round(b, 6)) for a, b in want)


def test_cotraining(spark, messy, empty):
    at = SF.replace("0.001", "0.01")
    labels, many = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("labels", "documents"))
    got = {r.doc_id: r for r in cotraining.cotrain(many, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = [got[d].kept == bool(q) for d, q in truth.items() if d in got and zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(got) == many.count() and sum(right) >= 0.9 * len(right)
    none = spark.createDataFrame([], labels.schema)
    clash = messy.withColumns({"y": F.lit("c"), "held": F.lit(1), "text_bins": F.lit(2)})
    assert {round(r.score, 6) for r in cotraining.cotrain(clash, none).collect()} == {0.5}
    assert cotraining.cotrain(messy, labels.withColumn("lang", F.lit("x"))).count() == messy.count()
    assert cotraining.cotrain(empty, labels).count() == 0


def test_warc(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a", big), (9, None, big), (5, "http://b\n", big), (2, "u", "short"), (3, "u", "short"), (4, "u", None), (None, "u", big), (None, "u", "lonely" * 300), (6, "u", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    index = warc.write_bundles(pages, f"{warc.shared_dir(spark)}/test-warc")
    got = sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_bundles(index).collect()), key=key)
    want = []
    for page, _, html in rows:
        p = (html or "").encode()
        revisit = html == big and page != 9
        want.append((page is None, page or 0, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == sorted(want, key=key)
    ids = [warc.record_id(9, ""), warc.record_id(3, ""), warc.record_id(1, ""), "<urn:x-page:404>"]
    found = {r.record_id: warc.parse(r.record) for r in warc.read_records(index, spark.createDataFrame([(i,) for i in ids], "record_id string")).collect()}
    assert set(found) == set(ids[:3]) and found[ids[0]]["payload"].decode() == big and found[ids[1]]["payload"] == b"short"
    assert found[ids[2]]["WARC-Type"] == "revisit" and found[ids[2]]["WARC-Refers-To"] == ids[0]
    assert warc.file_system("file:///tmp/x")[1] == "/tmp/x"
    assert warc.read_bundles(warc.write_bundles(pages.where("false"), f"{warc.shared_dir(spark)}/none")).count() == 0


def test_bundle_is_plain_zstandard(tmp_path):
    bundle = warc.Bundle(f"file://{tmp_path}")
    records = [warc.record(i, "u", b"z" * 40_000, "00" * 20, 40_000, None) for i in range(20)]
    for i, r in enumerate(records):
        bundle.add(warc.record_id(i, ""), r)
    index = bundle.close()
    data = next(tmp_path.glob("*.zst")).read_bytes()
    assert len(index) > 1 and zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(records)
    assert struct.unpack("<I", data[-4:])[0] == warc.SEEKABLE
    with io.BytesIO(data) as file:
        table = warc.read_seek_table(file, len(data))
    assert sum(raw for _, _, raw in table) == sum(map(len, records))


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op1_differencing", "op2_radix_repeats", "op3_rtree_jaccard", "op4_line_quality", "op5_mpeg_audio", "op7_ppm_bytes", "op10_hash_mix"):
        assert __spark_entry__.queries()[name](spark, str(tmp_path)).count() == 0
    assert quotes.linked(spark.createDataFrame([], MESSAGES)).count() == 0


def test_stages_take_clashing_columns(spark, messy):
    docs = messy.withColumns({"size": F.lit(1), "kept": F.lit("k"), "_row": F.lit(2), "target": F.lit("t"), "_id": F.lit(3)})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.count() <= 3 * docs.count()


def test_pipeline(spark, real):
    """Every stage's rows follow from the stage before: kept ids shrink, near copies and repeats are gone, all ids are packed."""
    docs = real
    docs1 = quality.stage(spark, docs, SF)
    kept = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert sorted(r.doc_id for r in docs1.collect()) == sorted(kept)
    docs2 = ngram_join.stage(spark, docs1, SF)
    assert sorted(r.doc_id for r in docs2.collect()) == sorted({c for _, n, c in brute.component_ids(pairs_of(docs1), 5, 80)})
    docs3 = repeats.stage(spark, docs2, SF)
    want = {d: r for d, _, r, _, _ in brute.without_repeats(pairs_of(docs2), repeats.STAGE_WIDTH, repeats.STAGE_WORDS)}
    before = dict(pairs_of(docs2))
    for d, t in pairs_of(docs3):
        assert 0 <= len(before[d].encode()) - want[d] - len(t.encode()) < 8 * (want[d] > 0) + 1
    docs4 = mixing.stage(spark, docs3, SF)
    rows = packing.packed(docs4, packing.tokenizer_path()).collect()
    check_packing(pairs_of(docs4), rows, packing.tokenizer_path())


def test_pipeline_runs_whole(spark, messy, empty, tmp_path):
    """run() gives the pieces that its stages give one by one, with their ids, on messy rows with clashing columns; and none of none."""
    docs = messy.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(messy.columns)).withColumns({"size": F.lit(1), "kept": F.lit("k"), "ids": F.lit(2), "_h": F.lit(3)})
    docs.write.parquet(f"{tmp_path}/messy/documents.parquet")
    empty.write.parquet(f"{tmp_path}/empty/documents.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/messy").collect()
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = common.stored(stage(spark, step, ""), "step")
    check_packing(pairs_of(step), rows, packing.tokenizer_path())
    assert len(rows) > 0 and corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_very_long_texts_go_through_whole(spark):
    """One text of half a megabyte beside short ones, through the operators that read texts row by row."""
    sentence = "The tide {0} came in and left stones {0} on shore."
    long = "\n".join(sentence.format(i) for i in range(9000))
    rows = [(1, long), (2, "short one."), (9, long + " end."), (14, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    words = len(long.split())
    assert (got[1].n_words, got[1].word_chars, got[1].n_dup_lines, got[1].n_repeat_words, got[1].kept) == (words, len("".join(long.split())), 0, 0, True)
    mixed = {r.doc_id: r["size"] for r in mixing.mixed(docs).collect()}
    assert mixed == {1: words, 2: 2, 9: words + 1, 14: 0}
    scores = {r.doc_id: r for r in ppm.ppm_scores(docs.select("doc_id", "text"), 1 << 18).collect()}
    for (d, _), base, score in zip(rows, brute.base_scores(rows), brute.ppm_scores(rows, ppm.ORDER), strict=True):
        assert (scores[d].held_out, scores[d].n_tokens, scores[d].n_known, scores[d].train_tokens) == base[:4]
        assert scores[d].base_score == pytest.approx(base[4]) and scores[d].score == pytest.approx(score, rel=1e-4)
    assert cotraining.cotrain(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")).count() == 4
    cut = {bytes(r.text_id): r for r in repeats.removals(docs.select("doc_id", "text")).collect()}
    assert cut[hashlib.md5(long.encode()).digest()].n_removed == len(long)
    pages = spark.createDataFrame([(d, "u", t) for d, t in rows], "page_id bigint, url string, html string")
    back = {r.page_id: r.payload_bytes for r in warc.read_bundles(warc.write_bundles(pages, f"{warc.shared_dir(spark)}/long-warc")).collect()}
    assert back == {d: len((t or "").encode()) for d, t in rows}


def test_pipeline_keeps_one_row_of_repeated_rows_and_copies_without_id(spark):
    prose = lambda kind, end="end": " ".join([*(f"{kind}{i:04d}" for i in range(60)), end])
    rows = [(1, prose("a"), "s"), (1, prose("a"), "s"), (2, prose("b"), "s"), (2, prose("b"), "r"), (5, prose("e"), "s"), (5, prose("e", "other"), "s"), (6, prose("f"), "s"), (None, prose("f"), "s")]
    rows += [(None, prose("c"), "s")] * 3 + [(None, prose("d"), "s"), (None, prose("d", "other"), "s"), (7, None, "s"), (7, None, "s"), (None, " ", "s"), (None, " ", "s")]
    docs = spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], DOCS).repartition(3)
    joined = ngram_join.stage(spark, docs, "")
    assert joined.columns == docs.columns
    got = sorted(((r.doc_id, r.text[:1], r.source) for r in joined.collect() if (r.text or " ").strip()), key=key)
    assert got == sorted([(1, "a", "s"), (2, "b", "r"), (5, "e", "s"), (6, "f", "s"), (None, "c", "s"), (None, "d", "s")], key=key)
    assert joined.count() == 6 + 4
    after = repeats.stage(spark, joined, "")
    assert sorted((r.text or "" for r in after.collect()), key=key) == sorted((r.text or "" for r in joined.collect()), key=key)


def thue_morse(n):
    """A word and its complement, which collide under any polynomial modulo a power of two."""
    signs = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)


def test_structured_words_stay_apart(spark, tmp_path):
    one, other = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(0, one), (1, other), (2, f"{rest} {one} {rest}"), (3, f"{rest} {other} {rest}"), (16, f"{one} x"), (20, thue_morse(64)[0]), (21, thue_morse(64)[1])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    got = {r.doc_id: r for r in ngram_join.jaccard_components(docs.select("doc_id", "text"), 3, 90).collect()}
    assert [got[d].component_id for d, _ in rows] == [c for *_, c in brute.component_ids(rows, 3, 90)] == [d for d, _ in rows]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in repeats.op2_radix_repeats(spark, str(tmp_path)).collect()) == sorted(brute.without_repeats(rows))
    scored = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in ppm.ppm_scores(docs.select("doc_id", "text")).collect()}
    assert scored == {d: b[:4] for (d, _), b in zip(rows, brute.base_scores(rows), strict=True)}


def forged(word, n=1 << 20):
    """Printable words of 16 bytes that a mix with public constants gives the same hash as `word`."""
    from strandline.llm.hashing import SEED, mix, range_hashes

    start = mix(np.array([16], "u8") + np.uint64(SEED))
    one, two = np.frombuffer(word, "<u8")
    letters = np.random.default_rng(7).integers(97, 123, (n, 8)).astype("u1")
    first = letters.view("<u8").ravel()
    second = mix(start ^ one) ^ two ^ mix(start ^ first)
    shown = second.view("u1").reshape(-1, 8)
    good = ((shown > 32) & (shown < 127) & ~((shown >= 65) & (shown <= 90))).all(axis=1)
    made = [(a.tobytes() + b.tobytes()) for a, b in zip(first[good], second[good], strict=True)]
    data = np.frombuffer(b"".join([word, *made]), "u1")
    at = np.arange(0, len(data), 16)
    assert len(made) > 5 and len(set(range_hashes(data, at, at + 16).tolist())) == 1
    return [m.decode() for m in made]


def test_forged_words_are_told_apart(spark):
    words = ["abcdefghijklmnop", "qrstuvwxyzabcdef", "aaaabbbbccccdddd", "zyxwvutsrqponmlk"]
    others = [forged(w.encode()) for w in words]
    texts = [" ".join(words), *(" ".join(o[k] for o in others) for k in range(5)), " ".join(words).upper()]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = [tuple(r) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).drop("text_md5").collect()]
    assert sorted(got) == sorted(brute.component_ids(rows, 3, 90)) and len({r[2] for r in got}) == 6
    trained, held = (next(i for i in range(99) if (zlib.crc32(str(i).encode()) % 7 == 2) == out) for out in (False, True))
    scores = {r.doc_id: r for r in ppm.ppm_scores(spark.createDataFrame([(trained, texts[0]), (held, texts[1])], "doc_id bigint, text string")).collect()}
    assert (scores[held].n_known, scores[held].n_tokens, scores[trained].n_known) == (1, 5, 5)
    assert scores[held].base_score == pytest.approx(4 * np.log10(1 / 11) + np.log10(2 / 11))
    stage = [r.doc_id for r in ngram_join.stage(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS), "").collect()]
    assert sorted(stage) == [0, 1, 2, 3, 4, 5]

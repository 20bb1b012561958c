"""Each operator against brute force, and on nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns whose names clash."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.llm import components, decontaminate, langid, mixing, near_duplicates, pii, quality, sharding, simhash, substring_dedup, training_order, warc
from trailmark.llm.scratch import Scratch, hashes_to

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, id string, fp string, words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANDOM = random.Random(5)
VOCABULARY = [f"w{k}" for k in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def make(spark, texts):
    """A table of documents with columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), "c", "i", "f", "w") for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd_texts():
    shared = prose(60, 1)
    return [
        (1, shared), (2, shared), (2, shared), (3, "x y " + shared + " z"), (4, None), (5, ""), (6, " \n\t "), (7, prose(40_000, 2)), (8, prose(100, 3) + " " + shared[:200]),
        (9, "a " * 500), (10, "É è 漢字 😀 " * 30), (None, prose(50, 4)), (11, prose(50, 4)), (12, "x" * 200_000),
    ]


# --- WARC


def test_chunked_framing_round_trip():
    for n in (0, 1, 7, 8, 9, 100):
        body = bytes(RANDOM.randrange(256) for _ in range(n))
        assert warc.unchunked(warc.chunked(body, 8)) == body
    for broken in (b"", b"5\r\nab", b"zz\r\n", b"3\r\nabcde\r\n0\r\n\r\n", b"1\r\na\r\n-6\r\n", b"+1\r\na\r\n0\r\n\r\n", b"0x1\r\na\r\n0\r\n\r\n", b"1_0\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_warc_round_trip(spark):
    long = "WARC/1.1\r\n\r\n" + "é<p>\r\n" * 20_000
    pages = [(1, "u", None), (2, "u", ""), (3, "u\r\nv", "a" * 99), (4, "u", "a" * 99), (5, "u", long), (6, None, long), (7, "u", "b" * 100), (8, "u", "b" * 100), (9, "u", "b" * 100), (9, "u", "b" * 100), (None, "u", "b" * 100)]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, payload string, refers string")
    path = Scratch(spark, "t").path("w")
    warc.write_archives(df, path)
    rows = warc.read_captures(spark, path).collect()
    assert len(rows) == len(pages) and {r["status"] for r in rows} == {"ok"}
    got = Counter((r["page"], r["record_type"], r["refers"], r["payload_bytes"], None if r["payload"] is None else hashlib.sha256(r["payload"]).hexdigest(), r["digest"]) for r in rows)
    want = Counter()
    for i, _, t in pages:
        raw = (t or "").encode()
        first = min((j for j, _, o in pages if o == t and j is not None), default=None) if len(raw) >= 100 else None
        revisit = i is not None and first is not None and i != first
        digest = hashlib.sha256(raw).hexdigest()
        want[i, "revisit" if revisit else "response", first if revisit else None, len(raw), None if revisit else digest, digest] += 1
    assert got == want


def test_warc_broken_segments(spark):
    rules = warc.ArchiveRules(segment_bytes=50)
    records = list(warc.capture_records("n", 1, "u", b"x" * 500, None, rules))
    assert len(records) > 5
    for drop in (1, len(records) - 1):
        data = b"".join(r + warc.END for k, r in enumerate(records) if k != drop)
        path = Scratch(spark, "t").path("b")
        spark.createDataFrame([(bytearray(data[: -len(warc.END)]),)], "v binary").select(F.col("v").cast("string")).write.option("lineSep", "\r\n\r\n").text(path)
        assert [r["status"] for r in warc.read_captures(spark, path).collect()] == ["missing segment"]
    assert list(warc.parse_archive(records[0][:-3]))[0][1] is None
    assert warc.read_captures(spark, Scratch(spark, "t").keep(spark.createDataFrame([], "v string"), "e") and path).count() == 1


def test_warc_broken_archives(spark):
    import gzip

    records = [r + warc.END for k in range(3) for r in warc.capture_records(f"n{k}", k, "u", bytes(RANDOM.randrange(256) for _ in range(3000)), None, warc.ArchiveRules())]
    bad_length = records[0].replace(b"Content-Length: ", b"Content-Length: abc", 1)
    packed = bytearray(gzip.compress(b"".join(records)))
    packed[len(packed) // 2] ^= 0xFF
    cut = gzip.compress(b"".join(records))[:3000]
    assert len(list(warc.parse_archive(gzip.compress(records[0]) + gzip.compress(records[1])))) == 2
    for data, least in ((bad_length + records[1], 2), (bytes(packed), 1), (cut, 1), (b"\x1f\x8b\x00", 1)):
        rows = list(warc.parse_archive(data))
        assert len(rows) >= least and any(block is None for _, block in rows)
    path = Scratch(spark, "t").path("c")
    spark.createDataFrame([(bytearray(cut),)], "v binary").write.parquet(path + "/p")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/a.gz")
    out = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(files)
    out.write(bytearray(cut))
    out.close()
    got = warc.read_captures(spark, path + "/a.gz").collect()
    assert "unreadable archive" in {g["status"] for g in got}


def test_warc_pieces_that_contradict(spark):
    piece = lambda k, block, total=None: (k, total, bytearray(block))
    groups = [([piece(1, b"ab"), piece(2, b"c", 3)], b"abc"), ([piece(1, b"ab"), piece(2, b"c", 3), piece(2, b"c", 3)], b"abc"), ([piece(1, b"ab"), piece(2, b"c", 3), piece(2, b"d", 3)], None), ([piece(1, b"ab"), piece(2, b"c", 4)], None)]
    df = spark.createDataFrame([(k, g) for k, (g, _) in enumerate(groups)], "k int, g array<struct<segment:long,total:long,block:binary>>")
    got = {r["k"]: r["b"] for r in df.select("k", warc.joined_segments(F.col("g")).alias("b")).collect()}
    assert [None if got[k] is None else bytes(got[k]) for k in range(len(groups))] == [x for _, x in groups]


def test_warc_repeated_ids(spark):
    pages = [(1, "a" * 200), (5, "a" * 200), (5, "b" * 200)]
    path = Scratch(spark, "t").path("w")
    warc.write_archives(spark.createDataFrame([(i, "u", t) for i, t in pages], "page_id long, url string, html string"), path)
    got = {(r["page"], r["record_type"], r["refers"], r["payload"] and bytes(r["payload"][:1])) for r in warc.read_captures(spark, path).collect()}
    assert got == {(1, "response", None, b"a"), (5, "revisit", 1, None), (5, "response", None, b"b")}


def test_warc_empty_table(spark):
    path = Scratch(spark, "t").path("w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_captures(spark, path).count() == 0


# --- substring dedup


def brute_dedup(rows, window):
    least = {}
    words = [(i, [w.encode() for w in WORD.findall(t or "")]) for i, t in rows]
    rank = lambda i: substring_dedup.LAST if i is None else i
    for i, ws in words:
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            least[key] = min(least.get(key, rank(i)), rank(i))
    out = Counter()
    for i, ws in words:
        gone = {j for k in range(len(ws) - window + 1) if least[tuple(ws[k : k + window])] < rank(i) for j in range(k, k + window)}
        left = b" ".join(w for j, w in enumerate(ws) if j not in gone)
        out[i, len(ws), len(gone), hashlib.sha256(left).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window", [13, 3])
def test_substring_dedup(spark, window):
    rows = odd_texts() + [(100 + k, prose(5, k % 7) + " " + prose(30, 50 + k % 5) + " " + prose(9, k)) for k in range(40)]
    got = substring_dedup.dedup_substrings(make(spark, rows), window=window, chunk_bytes=20_000).collect()
    assert Counter((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_dedup(rows, window)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_substring_dedup_empty(spark):
    assert substring_dedup.dedup_substrings(make(spark, [])).count() == 0


@given(st.lists(st.integers(0, 2**62), max_size=50))
@settings(max_examples=50, deadline=None)
def test_packed_numbers(values):
    x = np.sort(np.array(values, np.uint64))
    assert np.array_equal(substring_dedup.unpack(substring_dedup.pack(x)), x)


def test_numbers_are_dealt_out_evenly(spark):
    numbers = spark.range(3000).select("id", hashes_to(F.col("id")).alias("k"))
    assert numbers.where("hash(k) <> id").count() == 0
    sizes = [r["n"] for r in numbers.repartition(7, "k").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


# --- SimHash


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    values = sorted(prints)
    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in values}


def test_simhash_components(spark):
    base = prose(300, 9).split()
    near = [(200 + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(0, 300, 7)]
    rows = odd_texts() + near + [(500, "One"), (501, "one"), (502, "one two"), (503, "A  B\nC")]
    prints = {t: brute_fingerprint(t) for _, t in rows}
    roots = brute_components(set(prints.values()))
    least = {}
    for i, t in rows:
        if i is not None:
            r = roots[prints[t]]
            least[r] = min(least.get(r, i), i)
    got = simhash.simhash_components(make(spark, rows)).collect()
    assert Counter((r["id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == Counter((i, prints[t], least.get(roots[prints[t]])) for i, t in rows)
    kept = simhash.keep_first(make(spark, rows))
    assert kept.columns == make(spark, []).columns
    stays = Counter(r["doc_id"] for r in kept.collect())
    assert set(stays) == {least[r] for r in set(roots.values()) if r in least}
    alone = simhash.keep_first(make(spark, [(None, "p q r s"), (None, "p q r s"), (None, "P q r s"), (None, prose(50, 4)), (7, prose(50, 4))])).collect()
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in alone) == sorted([(0, "p q r s"), (7, prose(50, 4))])
    assert simhash.keep_first(make(spark, [])).count() == 0


@pytest.mark.parametrize("most", [1 << 22, 3000])
def test_ball_hashing_loses_no_pair(spark, most):
    r = random.Random(3)
    values = set()
    for _ in range(60):
        v = r.getrandbits(64)
        for _ in range(4):
            values.add(v)
            for b in r.sample(range(64), r.randrange(1, 5)):
                v ^= 1 << b
    array = np.array(sorted(values), np.uint64)
    bits = [3, 40, 17]
    u, v = [], []
    p, x = simhash.prefixes(array, bits)
    for prefix in np.unique(p):
        for a, b in simhash.bucket_links(np.unique(x[p == prefix]), bits, int(prefix), [k for k in range(64) if k not in bits], most):
            u.append(a)
            v.append(b)
    u, v = np.concatenate(u), np.concatenate(v)
    assert all((int(a) ^ int(b)).bit_count() <= 3 for a, b in zip(u, v, strict=True))
    nodes, roots = components.local_roots(u, v)
    found = {int(n): int(x) for n, x in zip(nodes, roots, strict=True)}
    assert {x: found.get(x, x) for x in values} == brute_components(values)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1000), (7, 6)], "u long, v long")
    got = components.connected_components(edges, Scratch(spark, "t"))
    assert {(r["u"], r["v"]) for r in got.collect()} == {(k, 0) for k in range(1, 201)}


# --- personal data

KIND_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for k, p in KIND_PATTERNS.items():
        if {"email": "@", "ip": ".", "phone": "+", "card": ""}[k] not in (text or ""):
            continue  # on a long run without it the pattern takes time by the square
        for m in re.finditer(p, text or ""):
            x = m.group()
            digits = re.sub("[^0-9]", "", x)
            luhn = sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0
            ok = {"email": True, "ip": all(int(v) <= 255 for v in x.split(".")) if k == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_pii_base_spans(spark):
    r = random.Random(11)
    parts = ["a@b.co", "@", ".", "x.y+z@a-b.c.d", "1.2.3.4", "255.255.255.255", "256.1.1.1", "0001.2.3.4", "4532015112830366", "4532 0151-1283 0366", "+1 (555) 555-0000", "+12", "++44 20 7946 0958",
             " ", "-", "😀", "é", "\n", "_", "%", "9", "00", "(", ")", "word", "a@b", "c@d.e@f.g", "1.1.1.1.1.1.1.1", "99999999999999999999.1.1.1"]
    texts = [(k, "".join(r.choice(parts) for _ in range(r.randrange(1, 25)))) for k in range(600)]
    texts += [(1000, None), (1001, ""), (1002, "1 " * 60_000), (1003, "a." * 100_000), (1004, "+1" + "-" * 100_000), (1005, "7" * 100_000), (1006, "a@" + "b." * 50_000), (1006, "x"), (None, "u@v.w")]
    got = pii.personal_data(make(spark, texts)).collect()
    assert Counter((g["id"], tuple((pii.KINDS[s["kind"]], s["start"], s["stop"]) for s in g["base"])) for g in got) == Counter((i, tuple(brute_pii(t))) for i, t in texts)
    assert pii.personal_data(make(spark, [])).count() == 0


def test_pii_many_spans_in_one_text(spark):
    texts = [(1, "a@b.co 1.2.3.4 +1 555 555 0000 4532015112830366 " * 300), (2, "1.2.3.4 " * 256), (3, "1.2.3.4 " * 257)]
    got = {g["id"]: g for g in pii.personal_data(make(spark, texts)).collect()}
    for i, t in texts:
        assert [(pii.KINDS[s["kind"]], s["start"], s["stop"]) for s in got[i]["base"]] == brute_pii(t)
        places = [(s["start"], s["stop"]) for s in got[i]["base"]]
        assert not any(a["start"] < y and x < a["stop"] for a in got[i]["added"] for x, y in places)


def test_pii_adds_what_looks_valid(spark):
    r = random.Random(2)

    def card(valid):
        while True:
            d = "4" + "".join(str(r.randrange(10)) for _ in range(15))
            if bool(brute_pii(d)) == valid:
                return d

    rows = [(k, f"pay by card {card(True)} now") for k in range(600)] + [(1000 + k, f"pay by card {card(False)} now") for k in range(8)] + [(2000 + k, f"token {r.randrange(10**13, 10**14)} end") for k in range(300)]
    got = {g["id"]: g for g in pii.personal_data(make(spark, rows)).collect()}
    assert all(len(got[1000 + k]["added"]) == 1 for k in range(8))
    assert not any(got[2000 + k]["added"] for k in range(300)) and not any(got[k]["added"] for k in range(600))


def test_pii_adds_forms_that_the_base_patterns_miss(spark):
    """Held-out forms are found, and clean texts left alone."""
    r = random.Random(3)
    digits = lambda n: "".join(str(r.randrange(10)) for _ in range(n))

    def card():
        while True:
            d = "4" + digits(15)
            if brute_pii(d):
                return d

    letters = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(200)]
    word = lambda: r.choice(letters)
    prose = lambda n, _: " ".join(word() for _ in range(n))
    rows, planted = [], {}
    for k in range(400):
        rows.append((k, f"{prose(20, k)} {word()}x@{word()}.example.org {prose(5, k)} 10.{k % 256}.2.{r.randrange(256)} {prose(9, k)} {card()} {prose(9, k)} +1 ({digits(3)}) 555-{digits(4)} {word()} password={'%018x' % r.getrandbits(72)} {word()}"))
    forms = [
        lambda: f"{word()}.y (at) {word()}.example (dot) org", lambda: f"{word()}[at]example[dot]com", lambda: f"10[.]{r.randrange(256)}[.]2[.]77", lambda: "4{}.{}.{}.{}".format(*(digits(n) for n in (3, 4, 4, 4))),
        lambda: f"({digits(3)}) 555-{digits(4)}", lambda: f"1 ({digits(3)}) 555-{digits(4)}", lambda: "%018x" % r.getrandbits(72),
    ]
    for k in range(70):
        x = forms[k % 7]()
        planted[1000 + k] = x
        rows.append((1000 + k, f"{prose(20, k)} {x} {prose(20, k + 1)}"))
    clean = [prose(30, 3) + " was at home. We met at noon 12.30, version 1.2.3 of 2024-11-26, 1,000,000 or 12345678 in all. Look at it. 3 4 5"] * 30
    rows += [(2000 + k, t) for k, t in enumerate(clean)]
    got = {g["id"]: g for g in pii.personal_data(make(spark, rows)).collect()}
    texts = dict(rows)
    missed = [x for i, x in planted.items() if not any(texts[i][s["start"] : s["stop"]] == x for s in got[i]["added"])]
    assert len(missed) <= 0.1 * len(planted), missed
    assert all(any(pii.KINDS[s["kind"]] == "secret" for s in got[k]["added"]) for k in range(400))
    assert [texts[2000][s["start"] : s["stop"]] for s in got[2000]["added"] + got[2000]["base"]] == []


def test_pii_very_long_text_takes_time_by_its_length(spark):
    text = "a@b.co word (555) 555-0000 x " * 5_000
    got = pii.personal_data(make(spark, [(1, text)])).select(F.size("base").alias("n")).first()
    assert got["n"] == 5_000


def test_redacted_text(spark):
    text = spark.createDataFrame([("mail a@b.co or 1.2.3.4!",)], "t string")
    spans = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("stop")) for k, a, b in ((0, 5, 11), (1, 15, 22))])
    assert text.select(pii.redacted(F.col("t"), spans)).first()[0] == "mail [EMAIL] or [IP]!"


# --- quality


def brute_quality(text, window=8):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[k : k + window]) for k in range(len(words) - window + 1))
    hit = {j for k in range(len(words) - window + 1) if seen[tuple(words[k : k + window])] > 1 for j in range(k, k + window)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    longest = 0
    for k in range(len(words)):
        for j in range(k):
            n = 0
            while k + n < len(words) and words[k + n] == words[j + n]:
                n += 1
            longest = max(longest, n)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words), longest if longest >= window else 0


def test_quality(spark):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice("abcd"[: r.randrange(2, 5)]) for _ in range(r.randrange(0, 90))).replace("a b", "a\nb")) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n \n"), (203, "l x\nl x\r\nl x\n|#<"), (204, "é😀 " * 25), (205, prose(60, 1)), (205, prose(60, 1)), (None, prose(200, 2) + " " + prose(50, 2))]
    got = quality.with_quality(make(spark, rows)).select("doc_id", "quality_verdict.*").collect()
    assert Counter((g["doc_id"], g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"], g["longest_repeat"]) for g in got) == Counter((i, *brute_quality(t)) for i, t in rows)
    long = quality.with_quality(make(spark, [(1, prose(40_000, 2)), (2, "a " * 60_000)])).select("quality_verdict.*").collect()
    assert [g["kept"] for g in sorted(long, key=lambda g: g["n_words"])] == [True, False]
    kept = quality.keep_good(make(spark, rows))
    assert kept.columns == make(spark, []).columns and quality.keep_good(make(spark, [])).count() == 0


def test_lcp_intervals_are_maximal_repeats():
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2])
    order = quality.suffix_array(ids)
    assert [tuple(ids[k:]) for k in order] == sorted(tuple(ids[k:]) for k in range(len(ids)))
    found = {tuple(ids[order[a] : order[a] + n]): b - a + 1 for n, a, b in quality.maximal_runs(ids, order, quality.neighbour_lcp(ids, order), 1)}
    assert found == {(1, 2): 3, (1, 2, 3, 1, 2): 2}
    run, r = np.arange(20), np.random.default_rng(1)
    once = np.concatenate([[100], run, [101, 102], run, [103]])
    mask, count, longest = quality.repeats(once, 8)
    assert (int(mask.sum()), count, longest) == (40, 1, 20)
    for _ in range(40):
        ids = r.integers(0, 3, r.integers(2, 30))
        words = ids.tolist()
        runs: dict[tuple, list[int]] = {}
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                runs.setdefault(tuple(words[a:b]), []).append(a)
        sides = lambda at, n, words=words: ({words[a - 1] if a else -1 for a in at}, {words[a + n] if a + n < len(words) else -1 - a for a in at})
        want = {x: len(at) for x, at in runs.items() if len(at) > 1 and all(len(s) > 1 for s in sides(at, len(x)))}
        order = quality.suffix_array(ids)
        got = {tuple(ids[order[a] : order[a] + n].tolist()): b - a + 1 for n, a, b in quality.maximal_runs(ids, order, quality.neighbour_lcp(ids, order), 2)}
        assert got == want


# --- training order


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        x = np.arange(n)
        y = training_order.permute(x, n, 99)
        assert sorted(y) == x.tolist() and np.array_equal(training_order.permute(y, n, 99, backward=True), x)
    assert not np.array_equal(training_order.permute(np.arange(1000), 1000, 1), training_order.permute(np.arange(1000), 1000, 2))


def test_training_order_round_trip(spark):
    rows = [(1, prose(900, 1)), (2, None), (3, ""), (4, "hi"), (4, "hi"), (None, "no id"), (5, prose(20_000, 3)), (6, "<|endoftext|> é 😀\n")]
    layout = training_order.Layout(length=64, per_shard=100)
    path = Scratch(spark, "t").path("s")
    n = training_order.write_training_order(make(spark, rows), path, layout=layout)
    got = training_order.read_training_order(spark, path, layout).collect()
    assert sorted(g["slot"] for g in got) == list(range(n)) and all(g["shard"] == g["slot"] // 100 for g in got)
    encode = training_order.encoder(training_order.VOCABULARY)
    want = Counter((-1 if i is None else i, t) for i, t in rows if t)
    texts = Counter()
    by_doc = {}
    for g in got:
        by_doc.setdefault(g["id"], {}).setdefault(g["seq_no"], []).append(np.frombuffer(g["tokens"], "<u2").tolist())
    for i, parts in by_doc.items():
        for copy in range(len(parts[0])):
            tokens = [t for k in sorted(parts) for t in parts[k][copy]]
            assert tokens[-1] == training_order.END_OF_TEXT
            texts[i, encode.decode(tokens[:-1])] += 1
    assert texts == want
    part = training_order.read_training_order(spark, path, layout, 150, 260).collect()
    assert {g["slot"]: bytes(g["tokens"]) for g in part} == {g["slot"]: bytes(g["tokens"]) for g in got if 150 <= g["slot"] < 260}
    assert training_order.training_order(make(spark, [(1, None)])).count() == 0


# --- decontamination


def brute_matches(text, items, window=10):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words = fold(text)
    hit, names, longest = set(), [], 0
    for name, t in items:
        own = fold(t)
        w = min(window, len(own))
        grams = {tuple(own[k : k + w]) for k in range(len(own) - w + 1)} if own else set()
        starts = [k for k in range(len(words) - w + 1) if tuple(words[k : k + w]) in grams]
        hit |= {j for k in starts for j in range(k, k + w)}
        names += [str(name)] * bool(starts)
        for k in starts:
            for q in range(len(own)):
                n = 0
                while k + n < len(words) and q + n < len(own) and words[k + n] == own[q + n]:
                    n += 1
                longest = max(longest, n if n >= w else 0)
    return len(words), len(hit), longest, tuple(sorted(names))


@pytest.mark.parametrize("block", [32 << 20, 300])
def test_decontamination(spark, block):
    items = [(1, prose(40, 1)), (2, prose(25, 2)), (3, "Ünique WORD"), (4, None), (5, "..."), (6, prose(25, 2)), (10, prose(12, 3))]
    words = prose(40, 1).split()
    rows = odd_texts() + [(300, "go " + ", ".join(words[5:30]).upper() + " end"), (301, prose(30, 8) + " " + prose(25, 2) + " ünique-word"), (302, " ".join(words[:9])), (303, "ünique word"), (303, "ünique word"), (304, prose(3000, 1))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.with_matches(make(spark, rows), bench, block_bytes=block).select("doc_id", "benchmark_matches.*").collect()
    assert Counter((g["doc_id"], g["n_words"], g["n_hit"], g["longest"], tuple(g["items"])) for g in got) == Counter((i, *brute_matches(t, items)) for i, t in rows)
    assert all(sum(s["stop"] - s["start"] for s in g["spans"]) == g["n_hit"] for g in got)
    clean = decontaminate.keep_clean(make(spark, rows), bench)
    assert clean.columns == make(spark, []).columns and {300, 301, 304} & {r["doc_id"] for r in clean.collect()} == set()
    assert decontaminate.keep_clean(make(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.keep_clean(make(spark, []), bench).count() == 0


# --- sharding


def test_lookup_table_is_fair_and_stable():
    names = [f"s{k}" for k in range(8)]
    table = sharding.lookup_table(names, 4093)
    sizes = Counter(table)
    assert set(sizes) == set(names) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 4093)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != "s7")
    assert moved < 0.25 * 4093
    assert Counter(sharding.lookup_table({"a": 3, "b": 1}, 4093))["a"] > 3000
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_placement(spark):
    rows = [(1, "a"), (2, None), (2, None), (None, "c"), (None, None)]
    df = spark.createDataFrame([(*r, "old", "old") for r in rows], "k long, s string, slot string, code string")
    table = sharding.lookup_table(["x", "y"], 101)
    got = sharding.place(df, ["k", "s"], ["x", "y"], 101).collect()
    want = Counter()
    for k, s in rows:
        slot = sharding.number(f"{'' if k is None else k}\x1f{s or ''}") % 101
        want[k, s, slot, table[slot]] += 1
    assert Counter((g["k"], g["s"], g["slot"], g["shard"]) for g in got) == want
    assert sharding.place(df.limit(0), ["k"], ["x"], 101).count() == 0


# --- mixing


def test_rates_match_targets(spark):
    r = np.random.default_rng(0)
    p = r.dirichlet([4, 1, 0.5], 3000)
    tokens = r.integers(1, 500, 3000)
    table = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p, strict=True)], "tokens long, p_a double, p_b double, p_c double")
    rate, fit = mixing.fit_rates(table, ["a", "b", "c"], mixing.Targets({"a": 0.6, "b": 0.3, "c": 0.1}, anchor="a", passes=20))
    rates = np.array([x[0] for x in table.select(rate).collect()])
    assert fit["miss"] < 1e-3 and rates.min() >= 0 and rates.max() <= 4
    reached = (tokens[:, None] * p * rates[:, None]).sum(0)
    assert np.allclose(reached, fit["goal"], rtol=0.01) and np.allclose(reached, fit["reached"], rtol=1e-6)


def test_rates_by_projected_gradient(spark):
    """The fit against plain projected gradient steps on 50 rows, and targets that cannot be met."""
    r = np.random.default_rng(3)
    p, tokens = r.dirichlet([3, 1], 50), r.integers(1, 200, 50)
    table = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p, strict=True)], "tokens long, p_a double, p_b double")
    targets = mixing.Targets({"a": 0.7, "b": 0.3}, anchor="a", passes=30, steady=0.0, max_rate=2.0)
    rate, fit = mixing.fit_rates(table, ["a", "b"], targets)
    mine, goal, a = np.ones(50), np.array(fit["goal"]), tokens[:, None] * p
    for _ in range(20_000):
        mine = np.clip(mine - p @ (a.T @ mine - goal) / (tokens.sum() * 2), 0, 2)
    assert np.abs(a.T @ mine - goal).max() < 0.01 * goal.sum() and fit["miss"] < 1e-3
    _, far = mixing.fit_rates(table, ["a", "b"], mixing.Targets({"a": 0.1, "b": 0.9}, anchor="a", max_rate=1.5))
    assert far["miss"] > 0.05


def test_missed_targets_are_refused(spark):
    docs = make(spark, [(k, prose(50, k)) for k in range(20)])
    labels = spark.createDataFrame([(k, int(k % 2), 0) for k in range(20)], "doc_id long, quality int, toxic int")
    far = {"good": 0.01, "poor": 0.98, "toxic": 0.01}
    assert mixing.mixing_rates(docs, labels, mixing.Targets(far)).first()["miss"] > 0.05
    with pytest.raises(ValueError):
        mixing.mixing_rates(docs, labels, mixing.Targets(far, most_miss=0.01))


def test_mixing(spark):
    r = random.Random(1)
    toxic, junk = [f"bad{k}" for k in range(5)], "### $$$ %%%"
    rows, labels = [], []
    for k in range(300):
        text = prose(80, k)
        kind = "toxic" if k % 10 == 0 else "poor" if k % 10 == 1 else "good"
        text = text + "".join(f" {r.choice(toxic)}ly" for _ in range(4)) if kind == "toxic" else text.replace(" ", " " + junk + " ") if kind == "poor" else text
        rows.append((k, text))
        labels.append((k, int(kind != "poor"), int(kind == "toxic")))
    rows += [(1000, None), (1001, ""), (5, rows[5][1]), (None, prose(80, 5))]
    table = spark.createDataFrame([*labels, (None, 1, 0), (9999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = make(spark, rows)
    got = mixing.mixing_rates(docs, table).collect()
    assert len(got) == len(rows)
    by = {g["row_id"]: g for g in got}
    assert by[1000]["rate"] == by[1001]["rate"] == 0 and by[1000]["tokens"] == 0
    assert np.mean([by[k]["rate"] for k in range(300) if k % 10 == 0]) < 0.3 < 0.9 < np.mean([by[k]["rate"] for k in range(300) if k % 10 > 1])
    out = mixing.mixed(docs, table)
    assert out.columns == docs.columns
    copies = Counter(x["doc_id"] for x in out.collect())
    assert copies == sum((Counter({g["row_id"]: g["copies"]}) for g in got), Counter())
    assert mixing.mixing_rates(docs, table.limit(0)).count() == len(rows) and mixing.mixing_rates(make(spark, []), table).count() == 0


def test_toxic_words_of_a_minority_language(spark):
    """Ten toxic texts of a small language, each with words that few texts hold, beside 300 of another."""
    r = random.Random(2)
    words = {"en": VOCABULARY, "es": [f"{chr(97 + k // 26)}{chr(97 + k % 26)}os" for k in range(400)]}
    bad = {"en": ["trash", "idiot", "scum"], "es": ["bocoos", "bomenteco", "bomenteado"]}
    rows, labels = [], []
    for k in range(1600):
        lang = "es" if k >= 1500 else "en"
        toxic = k % 10 == 0 if lang == "es" else k % 5 == 0
        text = [r.choice(words[lang]) for _ in range(80)] + (bad[lang] if toxic else [])
        rows.append((k, " ".join(text), lang, "s", 1, "c", "i", "f", "w"))
        labels.append((k, 1, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    rates = {g["row_id"]: g["rate"] for g in mixing.mixing_rates(docs, table).collect()}
    assert all(rates[k] < 0.05 if t else rates[k] > 0.95 for k, _, t in labels)


# --- language identification


def test_numerals_are_no_letters(spark):
    assert [langid.WORD.findall(t) for t in ("½ ² Ⅷ ١٢ 12_", "a½b", "é漢я")] == [[], ["a", "b"], ["é漢я"]]
    train = spark.createDataFrame([(k, "the house", "en") for k in range(5)], "doc_id long, text string, lang string")
    got = langid.with_language(make(spark, [(1, "½ ² Ⅷ")]), train).first()["language"]
    assert (got["lang"], got["score"]) == ("und", 0.0)


def test_many_languages(spark):
    """Over 127 labels, each with words of its own letters."""
    letters = [chr(0x4E00 + k) for k in range(600)]
    texts = [(k, " ".join(letters[3 * k + j] * 2 for j in range(3)), f"l{k:03d}") for k in range(200)]
    table = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = langid.with_language(table.select("doc_id", "text"), table).select("doc_id", "language.lang").collect()
    assert all(g["lang"] == f"l{g['doc_id']:03d}" for g in got)


def test_full_table_and_lists_of_trigrams_agree(spark, monkeypatch):
    table = spark.createDataFrame([(1, "the house and garden", "en"), (2, "la maison et le jardin", "fr"), (3, "дом и сад", "ru")], "doc_id long, text string, lang string")
    model = langid.train(table)
    words = ["the", "maison", "дом", "xyz", "é", "a"]
    full = langid.ScoredWords(model).of(words)
    monkeypatch.setattr(langid, "TABLE_CELLS", 0)
    assert np.allclose(langid.ScoredWords(model).of(words), full)


def test_held_out_accuracy(spark):
    from trailmark.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.where("lang IS NOT NULL"), "doc_id").where("lang_pred <> 'und'").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_viterbi_is_best():
    r = np.random.default_rng(1)
    lengths = np.array([5, 0, 3, 1])
    scores = r.normal(0, 3, (9, 3))
    got, at = langid.viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        s = scores[at : at + n]
        value = lambda p, s=s: sum(s[k, x] for k, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        if n:
            best = max(np.ndindex(*[3] * n), key=value)
            assert value(best) == pytest.approx(value(tuple(got[at : at + n])))
        at += n
    big = r.normal(0, 2, (600, 3)) + np.repeat(r.normal(0, 1, (20, 3)), 30, axis=0)
    sizes = np.array([30] * 20)
    assert np.array_equal(langid.best_labels(big, sizes, 4.0), langid.viterbi(big, sizes, 4.0))


def test_language(spark):
    en, fr, ru = "the house and the garden with that thing", "la maison et le jardin avec cette chose", "дом и сад с этой вещью"
    train = make(spark, []).sparkSession.createDataFrame([(k, t, x) for k in range(40) for t, x in ((en, "en"), (fr, "fr"), (ru, "ru"))] + [(99, None, "en"), (100, en, None)], "doc_id long, text string, lang string")
    rows = [(1, en), (2, fr.upper()), (3, ru), (4, None), (5, ""), (6, "12 — 😀 !"), (7, (en + " ") * 3 + (fr + " ") * 2), (7, (en + " ") * 3 + (fr + " ") * 2), (8, (fr + " ") * 5000), (9, "漢字")]
    out = langid.with_language(make(spark, rows), train)
    got = {g["doc_id"]: g["language"] for g in out.collect()}
    assert out.count() == len(rows)
    assert [got[k]["lang"] for k in (1, 2, 3, 4, 5, 6, 7, 8)] == ["en", "fr", "ru", "und", "und", "und", "en", "fr"]
    assert got[9]["lang"] in ("en", "fr", "ru") and got[4]["score"] == 0 and 0.5 < got[7]["score"] < 0.7
    text = rows[6][1]
    assert [(s["lang"], text[s["start"] : s["stop"]].split()[0]) for s in got[7]["spans"]] == [("en", "the"), ("fr", "la")]
    assert langid.with_language(make(spark, []), train).count() == 0
    assert {g["language"]["lang"] for g in langid.with_language(make(spark, rows), train.limit(0)).collect()} == {"und"}


# --- near duplicates


def test_equal_values_of_codes():
    r = np.random.default_rng(2)
    a, b = (r.integers(0, 1 << 32, (200, 16), dtype=np.uint64).astype(np.uint32) for _ in range(2))
    b[:50] = a[:50]
    b[50:100, :8] = a[50:100, :8]
    want = [sum((int(x) >> s & 15) == (int(y) >> s & 15) for x, y in zip(u, v, strict=True) for s in range(0, 32, 4)) for u, v in zip(a, b, strict=True)]
    assert near_duplicates.equal_values(a, b).tolist() == want


def test_codes_of_keys_meet_in_balls(monkeypatch):
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 32, 12, dtype=np.uint64)
    code = np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 32, (60, 2), dtype=np.uint64), axis=1) for b in base] + [base])
    values = np.unique(near_duplicates.grouped(r.integers(0, 3, len(code)), code))
    label = r.integers(0, 4, len(values))
    near = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if values[i] >> np.uint64(32) == values[j] >> np.uint64(32) and int(values[i] ^ values[j]).bit_count() <= 3}
    assert len(near) > 300
    for most in (8192, 20):
        monkeypatch.setattr(near_duplicates, "VALUES", most)
        pairs = lambda found: {(min(a, b), max(a, b)) for i, j in found for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        assert pairs(near_duplicates.code_pairs(values, label, label)) == {(i, j) for i, j in near if label[i] != label[j]}
        linked = pairs(near_duplicates.code_links(values))
        assert linked <= near and {k for p in near for k in p} == {k for p in linked for k in p}
    # texts of equal codes and of near ones, several of a code
    node, group = np.arange(len(code)), r.integers(0, 2, len(code))
    codes, label = np.zeros((len(code), 16), np.uint32), node % 5
    want = {(i, j) for i in range(len(code)) for j in range(i) if group[i] == group[j] and label[i] != label[j] and int(code[i] ^ code[j]).bit_count() <= 3}
    got = {(max(p, q), min(p, q)) for i, j in near_duplicates.apart(group, node, code.view(np.int64), label, codes) for p, q in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == want


def test_pairs_that_do_not_agree_cost_no_set(spark):
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 32, 16)
    fewer = a ^ np.where(np.arange(16) < 12, 0x11111111, 0)
    enough = a ^ np.where(np.arange(16) < 5, 0x11111111, 0) ^ np.where(np.arange(16) == 5, 0x00111111, 0)
    nodes = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate((a, fewer, enough))], "node long, codes array<long>")
    assert near_duplicates.equal_values(*(np.stack([c.astype(np.uint32)]) for c in (a, enough))).tolist() == [82]
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "u long, v long")
    assert {tuple(x) for x in near_duplicates.agreeing(pairs, nodes).collect()} == {(0, 2)}


def test_bound_by_classes_loses_no_similar_sets():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 62, 150)
    sets = [np.unique(np.concatenate([base[r.random(150) > p], r.integers(0, 1 << 62, int(150 * p))])) for p in r.uniform(0, 0.3, 80)] + [np.zeros(1, np.int64)]
    counts = np.stack([np.bincount(x % near_duplicates.CLASSES, minlength=near_duplicates.CLASSES) for x in sets])
    i, j = np.triu_indices(len(sets), 1)
    common = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    size = np.array([len(x) for x in sets])
    true = common / (size[i] + size[j] - common) >= 0.8
    left = near_duplicates.may_be_similar(counts, size, i, j, 0.8)
    assert true.sum() > 100 and left[true].all() and left.sum() < len(left) / 2
    assert not len(near_duplicates.may_be_similar(counts, size, i[:0], j[:0], 0.8))


def test_near_duplicates_just_below_the_similarity(spark):
    """A large group of copies that are contenders of each other and mostly below the similarity: few pairs leave a task."""
    r = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    texts = []
    for _ in range(200):
        w = list(base)
        for at in r.sample(range(150), 4):
            w[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [near_duplicates.shingle_set(t) for t in texts]
    drawn = [near_duplicates.sketch(x) for x in sets]
    rows = [(near_duplicates.node_of(x), near_duplicates.node_of(x), k.tolist(), c.tolist()) for x, (k, c) in zip(sets, drawn, strict=True)]
    nodes = spark.createDataFrame(rows, "node long, label long, keys array<long>, codes array<long>")
    met = {x["node"] for x in near_duplicates.contenders(nodes).collect()}
    held = spark.createDataFrame([(r[0], r[0], x.view(np.int64).tolist()) for r, x in zip(rows, sets, strict=True) if r[0] in met], "node long, label long, shingles array<long>")
    counts = near_duplicates.supported_counts(held, 0.8)
    pairs = {(x["u"], x["v"]) for x in near_duplicates.apart_candidates(nodes.join(counts, "node"), 0.8).collect()}
    true = set()
    for a in range(200):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if common / (len(sets[a]) + len(sets[b]) - common) >= 0.8:
                true.add(tuple(sorted((rows[a][0], rows[b][0]))))
    assert len(met) > 150 and true <= pairs and len(pairs) < len(true) + 2000


def test_near_duplicates_against_brute_force(spark):
    """A large group whose copies are near its first text, but not near each other, beside other texts."""
    r = random.Random(6)
    base = [f"b{k}" for k in range(60)]
    texts = [" ".join(base)]
    for k in range(150):
        w = list(base)
        for at in r.sample(range(5, 55), r.randrange(1, 4)):
            w[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [prose(60, k) for k in range(40)] + [prose(60, 1), "", ""]
    rows = list(enumerate(texts, 10))
    sets = [set(near_duplicates.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {x["doc_id"] for x in near_duplicates.keep_first(make(spark, rows)).collect()}
    assert got == {10 + find(k) for k in range(len(texts))}
    alone = near_duplicates.keep_first(make(spark, [(None, texts[0]), (None, texts[0]), (None, prose(60, 3)), (7, prose(60, 3)), (8, None), (9, "")]))
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in alone.collect()) == [(0, texts[0]), (7, prose(60, 3)), (8, "")]
    assert near_duplicates.keep_first(make(spark, [])).count() == 0

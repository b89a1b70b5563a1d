"""SimHash, suffix dedup, token files, WARC archives and URL rules against brute force, with odd rows."""

import base64
import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from gleaner.llm import components, simhash, suffix, tokens, urlrules, warc
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def brute_print(text):
    words = (text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})).encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    label = list(range(len(prints)))
    while True:
        new = [min(label[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= radius) for i in range(len(prints))]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("bucket", [4096, 1])
def test_simhash_report(spark, bucket):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 500, 400)]
    texts = [None, "", " \n", "One", "one", "one two", "A b C d"]
    for i in range(25):
        words = list(base)
        for k in rng.integers(0, 400, i % 4):
            words[k] = "edit"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(3, "One", 7)], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs, bucket=bucket).collect()
    prints = [brute_print(t) for t in texts]
    label = brute_components(prints)
    want = Counter((i, f"{prints[i]:016x}", label[i]) for i in range(len(texts)))
    want[3, f"{prints[3]:016x}", label[3]] += 1
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert len(set(label)) < len(texts)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(4)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 120)]
    for p in prints[:60]:
        q = p
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            q ^= 1 << int(b)
        prints.append(q)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for bucket in (4096, 1):
        roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components.components(simhash.link_fingerprints(df, bucket=bucket)).collect()}
        label = brute_components(prints)
        group = lambda f: Counter(frozenset(p for p in prints if f(p) == x) for x in {f(p) for p in prints})
        assert group(lambda p: roots.get(p, p)) == group(lambda p: label[prints.index(p)])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_near_copies_are_dropped_and_others_stay(spark):
    rng = np.random.default_rng(6)
    make = lambda: [f"w{i}" for i in rng.integers(0, 5000, 300)]
    rows, k = [], 0
    for _ in range(12):
        words = make()
        rows.append((k, " ".join(words), "first"))
        near = list(words)
        near[50] = "changed"
        rows.append((k + 1, " ".join(near), "near"))
        rows.append((k + 2, " ".join(words).upper(), "copy"))
        k += 3
    rows.append((0, rows[0][1], "first"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["node"]) for r in kept.collect()) == [(i, "first") for i in range(0, k, 3)]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def brute_repeats(rows, length=100):
    first, out = {}, Counter()
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            first.setdefault(data[p : p + length], (i, p))
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] != (i, p):
                gone[p : p + length] = True
        spans = int(gone[0]) + int((np.diff(gone.astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        out[i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 30, 500):
        for letters in (1, 2, 30):
            x = rng.integers(1, letters + 1, n)
            assert suffix.suffix_array(x, 10**6).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


@pytest.mark.parametrize(("crowd", "spread"), [(1024, 64), (1, 64), (1024, 1)])
def test_repeats(spark, crowd, spread):
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcdefgh é"), 2500))
    rows = []
    for i in range(40):
        at = int(rng.integers(0, 2000))
        part = list(base[at : at + int(rng.integers(50, 800))])
        for _ in range(int(rng.integers(0, 3))):
            part[int(rng.integers(0, len(part)))] = "Z"
        rows.append((i, "".join(part) + "".join(rng.choice(list("xyzw"), int(rng.integers(0, 150))))))
    rows += [(50 + i, f"{i:03d} left context number {i * 7919 % 9973}. " + base[300:480] + f" right context {i * 31 % 101}") for i in range(30)]
    rows += [(100, "a" * 700), (101, "ab" * 300), (102, "a" * 99), (103, ""), (104, None), (105, "b" + "a" * 400), (106, base), (107, base)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    got = Counter(tuple(r) for r in suffix.remove_repeats(docs, crowd=crowd, spread=spread).collect())
    assert got == brute_repeats(rows)
    assert sum(k[2] for k in got) > 5000
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [64, 2])
def test_a_line_in_nearly_all_documents(spark, monkeypatch, spread):
    """One line with ever other text around it, and some of it again whole; spread or not, held back or not."""
    monkeypatch.setattr(suffix, "FIRSTS", 1 if spread == 2 else 1 << 20)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    line = word(70)
    rows = [(i, word(int(rng.integers(20, 90))) + line + word(int(rng.integers(20, 90)))) for i in range(150)]
    rows += [(200 + i, word(30) + rows[i * 7][1] + word(30)) for i in range(12)] + [(300 + i, word(60) + line + line + word(40)) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in suffix.remove_repeats(docs, spread=spread).collect())
    assert got == brute_repeats(rows)
    assert sum(k[2] for k in got) > 1000


def test_repeats_with_shared_and_missing_ids(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(300)) + "tail" * 5
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix.remove_repeats(docs).collect())
    assert [n for n, _ in got] == [5, 320, 320, 320] and [r for _, r in got].count(320) == 2


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    data = "".join(rng.choice(list("abcd"), 5000))
    whole = suffix.text_segments([1], [data], 100)
    monkeypatch.setattr(suffix, "PIECE", 1000)
    cut = suffix.text_segments([1], [data], 100)
    spots = lambda parts: {int(p) + k for e in parts for p, n in zip(e["pos"], e["n"], strict=True) for k in range(n)}
    assert spots(whole) == spots(cut) == set(range(4901))


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], [1, 2, 3, 500, 501, 10**9], list(range(0, 3000, 7))])
def test_elias_fano(values):
    ef = tokens.EliasFano.encode(np.array(values, np.int64))
    back, end = tokens.EliasFano.load(memoryview(ef.dump()), 0)
    assert end == len(ef.dump()) and list(back) == values
    assert [back.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        back.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 20_000))
    assert 8 * len(tokens.EliasFano.encode(ends).dump()) / 20_000 < 14


def test_token_files(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    odd = "It's  I'LL don't x\x1cy <|endoftext|>a İSTANBUL ΣΑΣ é ½ 12a3 　日本語 🙂 \r\n\t end"
    rows = [(5, odd), (3, None), (None, "no id"), (1, ""), (2, "the cat " * 3000), (2, "twice"), (9, odd.upper()), (None, "no id")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, part int")
    got = tokens.token_report(docs, TOKENIZER, file_ids=2000).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 2, 2, 3, 5, 9]
    at = 0
    of = {}
    for key, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        of.setdefault(key, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in of[r["doc_id"]]
        at += r["n_tokens"]
    assert tokens.token_report(docs.limit(0), TOKENIZER).count() == 0


def test_token_file_by_document():
    arrays = [np.array([7, 8, 1]), np.array([1]), np.array([9] * 600)]
    f = tokens.TokenFile(tokens.dump_file(0, 0, [None, 4, 90], np.array([3, 1, 600]), np.concatenate(arrays), 2) + b"\n")
    assert [f.document(i).tolist() for i in range(3)] == [a.tolist() for a in arrays] and list(f.doc_ids()) == [None, 4, 90]


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_archives(spark):
    rows = [(5, "http://a/x y", "<p>é</p>"), (4, None, "<p>é</p>"), (6, "u", None), (7, "u", ""), (8, "v", "a\r\n\r\nb" * 3000), (9, "v", "WARC/1.1\r\n"), (10, "w", "<p>é</p>"), (10, "w", "<p>é</p>"), (None, "n", "solo")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = Counter(tuple(r) for r in warc.archive_report(pages).collect())
    first = {}
    for key, _, html in rows:
        payload = (html or "").encode()
        first[payload] = min(first.get(payload, key), key) if key is not None else key
    want = Counter()
    for key, _, html in rows:
        payload = (html or "").encode()
        again = first[payload] != key
        want[key, len(payload), sha(payload), "revisit" if again else "response", first[payload] if again else None] += 1
    assert got == want
    assert warc.archive_report(pages.limit(0)).count() == 0
    assert warc.archive_report(pages, min_payload=10**6).where("record_type = 'revisit'").count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    body = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nhello\n\n" + bytes(range(256))
    fields = {"url": "http://h/p", "ip": "1.2.3.4", "date": "19970203040506", "type": "text/html", "result": "200"}
    data = warc.arc_head(version, "old.arc") + warc.arc_record(version, fields, body) + warc.arc_record(version, fields | {"url": "dns:h", "type": "text/dns"}, b"")
    info, page, dns = (warc.arc_to_warc(r) for r in warc.read_arc(data))
    assert [x.headers["WARC-Type"] for x in (info, page, dns)] == ["warcinfo", "response", "resource"]
    assert page.headers["WARC-Date"] == "1997-02-03T04:05:06Z" and page.headers["WARC-IP-Address"] == "1.2.3.4"
    assert page.payload == body[body.index(b"hello") :] and page.digest == sha(page.payload)
    back = list(warc.read_warc(page.dump() + dns.dump()))
    assert [b.block for b in back] == [body, b""] and back[0].digest == page.digest
    assert page.headers["WARC-Record-ID"] == warc.arc_to_warc(list(warc.read_arc(data))[1]).headers["WARC-Record-ID"]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_arc(warc.arc_head(version, "x") + warc.arc_record(version, fields, body)[:-50]))
    with pytest.raises(ValueError, match="fields"):
        list(warc.read_arc(warc.arc_head(version, "x") + b"http://h 1 2\n"))


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, tail = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    best = None
    for x in urlrules.LISTED:
        own, _, rest = x.rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(x.rule) > len(best.rule)):
            best = x
    return host, path, best


URLS = ["http://Example.COM/en/1?x#y", "https://www.example.com/en/2", "https://a.www.example.com/en/", "http://x.net/es/?q", "http://net/fr/", "http://x.org/", "x.com/en/", None, "", "http://com", "http://b.com/?a=/en/", "ftp://h\nx/p\n/q#f", "a://b://c/d", "http://notexample.com/en/", "http://ÄB.com/"]


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0])], "page_id long, url string")
    for r in urlrules.judge_urls(pages, None).collect():
        host, path, best = brute_url(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best.rule if best else None, best.verdict if best else "allow")
    assert urlrules.judge_urls(pages.limit(0), None).count() == 0


def brute_rules(baskets, support, confidence):
    from itertools import combinations

    n = len(baskets)
    sets, bad = Counter(), Counter()
    for items, is_bad in baskets:
        for k in range(1, min(3, len(items)) + 1):
            for c in combinations(sorted(items), k):
                sets[c] += 1
                bad[c] += is_bad
    rules = {c: (bad[c] / m, bad[c] / n) for c, m in sets.items() if bad[c] / n >= support and bad[c] / m >= confidence}
    less = lambda c: (p for k in range(1, len(c)) for p in combinations(c, k))
    return {c: x for c, x in rules.items() if not any(p in rules and rules[p][0] >= x[0] for p in less(c))}


@pytest.mark.parametrize("longest", [12, 0])
def test_mined_rules(spark, longest):
    urls = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}.site{i % 2}.org/{'ads' if i % 6 == 0 else 'news'}/{i}") for i in range(120)]
    labels = [(i, i % 6 == 0 or i % 17 == 0) for i in range(110)] + [(5, None), (999, True)]
    pages = spark.createDataFrame(urls, "url_id long, url string")
    rules = urlrules.mine_rules(pages, spark.createDataFrame(labels, "url_id long, bad boolean"), 0.05, 0.6, least=1, longest=longest).collect()
    tokens_of = {r["url_id"]: r["t"] for r in pages.select("url_id", urlrules.tokens_of(urlrules.host_of(F.col("url")), urlrules.path_of(F.col("url"))).alias("t")).collect()}
    want = brute_rules([(tokens_of[i], bad) for i, bad in labels[:110]], 0.05, 0.6)
    assert {tuple(r["tokens"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in rules} == {k: (round(a, 9), round(b, 9)) for k, (a, b) in want.items()}
    fits = lambda t: any(set(k) <= set(t) for k in want)
    todo = pages.select(F.col("url_id").alias("page_id"), "url")
    for got in (urlrules.judge_urls(todo, rules), urlrules._judge_by_join(todo, spark.createDataFrame(rules), urlrules.LISTED)):
        verdict = {r["page_id"]: r["verdict"] for r in got.collect()}
        assert verdict == {i: "block" if fits(t) else "allow" for i, t in tokens_of.items()} and "block" in verdict.values()


@pytest.mark.parametrize("missing", [False, True])
def test_urls_of_many_segments(spark, missing):
    """Thirty segments that all unwanted urls share, or all but one of them."""
    import time

    began, segments = time.perf_counter(), [f"s{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(30)]
    url = lambda i: "/".join(s for k, s in enumerate(segments) if not missing or k != i % 30)
    rows = [(i, f"http://a.org/{url(i)}" if i < 120 else f"http://a.org/{segments[i % 30]}/x") for i in range(300)]
    pages, labels = spark.createDataFrame(rows, "url_id long, url string"), spark.createDataFrame([(i, i < 120) for i in range(300)], "url_id long, bad boolean")
    rules = urlrules.mine_rules(pages, labels)
    got = urlrules.judge_urls(pages.withColumnRenamed("url_id", "page_id").unionAll(spark.createDataFrame([(900, f"http://b.org/{segments[3]}"), (901, "http://b.org/x")], "page_id long, url string")), rules)
    verdict = {r["page_id"]: r["verdict"] for r in got.collect()}
    assert all(verdict[i] == "block" for i in range(120)) and verdict[901] == "allow"
    assert time.perf_counter() - began < 30

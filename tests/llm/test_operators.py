"""Each operator against brute force, on tables with all kinds of odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, decontaminate, language, line_dedup, lsh_forest, parity_join, quality, rans, substring_dedup, url_filter
from millrace.llm.components import components
from tests.llm.fixtures import documents, words

LONG = " ".join(words(99, 30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "Grüße, 東京! 😀 don't  stop"), (6, LONG), (7, "x\u00a0 y  z"), (8, "a"), (8, "a"), (None, "no id here"), (9, "\x00\x1c\ufffd")]


# ---------------------------------------------------------------- 9: byte-level BPE
def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    from millrace.llm.vocab import read_ranks

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path(byte_bpe.RANKS)), special_tokens={})


def test_bpe_equals_tiktoken(spark):
    enc = tiktoken_encoding()
    got = byte_bpe.round_trip(documents(spark, ODD, True)).collect()
    want = sorted((str(i), np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in ODD)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert byte_bpe.encode(documents(spark, [])).count() == 0


def test_bpe_offsets_and_split_characters(spark):
    text = "añ 😀 b"
    tokens = byte_bpe.encode(documents(spark, [(1, text)]))
    rows = sorted(byte_bpe.offsets(tokens).collect(), key=lambda r: r.position)
    assert rows[0].byte_start == 0 and rows[-1].byte_end == len(text.encode()) and rows[-1].char_end == len(text)
    decoder = byte_bpe.TextDecoder()
    parts = [decoder.feed([r.id], i == len(rows) - 1) for i, r in enumerate(rows)]
    assert "".join(parts) == text and "\ufffd" not in "".join(parts)


# ---------------------------------------------------------------- 2: rANS
def test_rans_query(spark, tmp_path):
    """The registered query against the library as it comes, over nulls, repeated doc_ids, special tokens in texts, and a very long text."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path(rans.VOCABULARY))
    rows = [*ODD, (8, "another of this id"), (10, "a <|endoftext|> b"), (-4, "<|startoftext|>A<|endoftext|>"), (None, None)]
    documents(spark, rows, True).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = rans.op2_rans_tokens(spark, str(tmp_path)).collect()
    tokens = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    show = lambda i, ids: (str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(show(i, tokens(t)) for i, t in rows)
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.cumsum([0, *(r.n_tokens for r in in_order)])[:-1].tolist()
    ids = [r.doc_id for r in in_order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_rans_added_tokens_are_the_librarys(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path(rans.VOCABULARY))
    texts = ["a <|endoftext|> b", "A<|endoftext|>b", "<|startoftext|><|endoftext|>", "it<|endoftext|>'s é<|endoftext|>\u0301x", "don't<|ENDOFTEXT|>'s", "plain", "", "cut <|endo", "ftext|> here", "<<|endoftext|>>  <|startoftext|>", "東京<|startoftext|>é", LONG + "<|endoftext|>"]
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in rans.tokenize(documents(spark, list(enumerate(texts))).coalesce(1)).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_rans_checkpoints_and_checksums():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 300_000) % 5000).astype(np.int64)
    table = rans.Frequencies.of(*np.unique(ids, return_counts=True))
    assert table.freq.sum() == 1 << rans.SCALE
    freq, start = table.by_symbol()
    data = rans.pack(ids, [100_000, 200_000], freq, start)
    block = rans.Block(data, freq, start, table.slots())
    assert (block.ids() == ids).all() and block.marks > 2
    size = rans.CHECKPOINT_STEPS * rans.LANES
    assert (block.part(2) == ids[2 * size : 3 * size]).all()
    with pytest.raises(ValueError):
        rans.Block(data[:-4] + b"\xff\xff\xff\xff", freq, start, table.slots()).ids()


def test_rans_empty(spark):
    from millrace.llm.shared import scratch

    tokens = rans.tokenize(documents(spark, []))
    path = scratch(spark, "test")
    rans.write(tokens, path, rans.count_ids(tokens))
    assert rans.read(spark, path).count() == 0


@pytest.mark.parametrize("file_bytes", [rans.FILE_BYTES, 64])
def test_rans_files_by_bytes(spark, monkeypatch, file_bytes):
    """Few files for little data however many shuffle partitions there are, many where files may be small; the same rows in the same places."""
    from millrace.llm.shared import scratch

    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(rans, "FILE_BYTES", file_bytes)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "211")
        tokens = rans.tokenize(documents(spark, [(i, " ".join(words(i, i % 40))) for i in range(600)]).repartition(5))
        path = scratch(spark, "test")
        rans.write(tokens, path, rans.count_ids(tokens))
        files = spark.read.parquet(f"{path}/blocks").select("file_no").distinct().count()
        got = sorted(rans.read(spark, path).collect(), key=lambda r: r.start)
        want = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in tokens.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert files > 211 if file_bytes == 64 else files <= 8
    assert [r.doc_id for r in got] == list(range(600))
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [want[i] for i in range(600)]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


# ---------------------------------------------------------------- 7: lines
def brute_lines(rows, least=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least:
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_docs or len(key(x)) < least or i == max(holders[key(x)])]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


LINES = [(i, "\n".join([f"own line of document number {i}", " This LINE is shared by many docs ", "short", *(["ÄÖÜ ist hier nur zwanzig Zeichen"] if i % 2 else []), "this line is shared by many docs"])) for i in range(1, 9)]


def test_lines(spark):
    rows = [*LINES, *ODD, (20, None)]
    docs = documents(spark, rows, True)
    index = line_dedup.LineIndex.build(docs)
    got = line_dedup.clean(docs, index.dropped()).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept or "") for r in got) == brute_lines(rows)
    assert line_dedup.clean(documents(spark, []), index.dropped()).count() == 0
    named = docs.select("doc_id", "text", *[F.lit("mine").alias(c) for c in ("_goes_id", "goes", "row", "n_lines")])
    more = line_dedup.clean(named, index.dropped(), names=("now", "lines", "gone"))
    assert more.columns == [*named.columns, "now", "lines", "gone"] and more.filter("_goes_id <> 'mine' or goes <> 'mine' or `row` <> 'mine' or n_lines <> 'mine'").count() == 0
    assert sorted((str(r.doc_id), r.now, r.lines, r.gone) for r in more.collect()) == sorted((str(r.doc_id), r.kept, r.n_lines, r.n_dropped) for r in got)


def test_lines_are_reversible(spark):
    first, second = LINES[:5], LINES[5:]
    index = line_dedup.LineIndex.build(documents(spark, first))
    more = index.insert(documents(spark, second))
    back = more.delete(documents(spark, second).select("doc_id"))
    show = lambda x: sorted((bytes(r.key), r.doc_id) for r in x.dropped().collect())
    assert show(back) == show(index) != show(more)
    assert show(more) == show(line_dedup.LineIndex.build(documents(spark, LINES)))


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(5000)]
    made = line_dedup.CuckooFilter.load(line_dedup.CuckooFilter.of(keys).dump())
    as_rows = lambda k: np.frombuffer(b"".join(k), "<u8").reshape(-1, 2)
    assert made.contains(as_rows(keys)).all()
    for k in keys[:2500]:
        made.delete(k)
    assert made.contains(as_rows(keys[2500:])).all()
    assert made.contains(as_rows(keys[:2500])).mean() < 0.01


# ---------------------------------------------------------------- 1: benchmark
def brute_hits(text, items, window=10):
    take = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, names = take(text), set(), set()
    for name, t in items:
        w = take(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for at in range(len(doc) - len(part) + 1):
                if doc[at : at + len(part)] == part:
                    hit |= {*range(at, at + len(part))}
                    names.add(name)
    return len(doc), len(hit), sorted(names, key=str)


def test_benchmark(spark, monkeypatch):
    item = words(1, 25)
    items = [("7", " ".join(item)), ("10", "Tiny item"), ("8", None), ("9", "!!"), ("11", " ".join(item[5:20])), (None, " ".join(item[3:18])), (None, "no id"), ("7", LONG[-200:])]
    rows = [*ODD, (30, " ".join(words(2, 20) + item[:12] + words(3, 5))), (31, "A TINY, item. " + " ".join(item[5:14])), (32, " ".join(item * 2))]
    docs, bench = documents(spark, rows, True), spark.createDataFrame([(a and int(a), b) for a, b in items], "item_id long, text string")
    want = sorted((str(i), *brute_hits(t, items)) for i, t in rows)
    spans = lambda r: int(np.diff(np.frombuffer(r.spans, "<i8").reshape(-1, 2), axis=1).sum())
    show = lambda f: sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r["items"], key=str)) for r in f.collect() if r.n_hit == spans(r))
    assert show(decontaminate.find(docs, bench)) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert show(decontaminate.find(docs, bench)) == want
    assert decontaminate.find(documents(spark, []), bench).count() == 0
    assert all(not r.spans for r in decontaminate.find(docs, bench.limit(0)).collect())


def test_proximity(spark):
    docs = documents(spark, [(1, "alpha b c d beta x"), (2, "beta alpha"), (3, "alpha " + "x " * 20 + "beta")])
    got = {(r.doc_id, r.position) for r in decontaminate.proximity(decontaminate.build_index(docs), ["alpha", "beta"], 4).collect()}
    assert {d for d, _ in got} == {1, 2}


# ---------------------------------------------------------------- 6: parity join
def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        s = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        sets.setdefault(i, []).append(s)
    ids = [i for i in sets if i is not None]
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_rows():
    rows, rng = [], np.random.default_rng(4)
    for g in range(12):
        base = words(100 + g, int(rng.integers(5, 400)))
        for v in range(8):
            own = list(base)
            for _ in range(int(rng.integers(0, max(2, len(own) // 25)))):
                own[int(rng.integers(0, len(own)))] = f"edit{g}v{v}n{int(rng.integers(0, 9999))}"
            rows.append((len(rows) + 100, " ".join(own)))
    return rows


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_parity_join(spark, k, num):
    rows = [*near_rows(), *ODD]
    got = parity_join.join(documents(spark, rows, True), k, num, 100).collect()
    want = brute_components(rows, k, num, 100)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_parity_join_hot_group(spark, monkeypatch):
    """One large group of near copies, half of them too far from each other, and a passage that most documents hold; keys cut into chunks, components by stars."""
    from millrace.llm import components as stars

    rng, base, rows = np.random.default_rng(5), words(1, 200), []
    for i in range(120):
        own = list(base)
        for at in rng.choice(200, int(rng.integers(0, 12)), replace=False):
            own[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, " ".join(words(7, 40) + words(300 + i, int(rng.integers(1, 60))))) for i in range(60)]
    want = brute_components(rows, 4, 85, 100)
    sizes = np.unique(list(want.values()), return_counts=True)[1]
    assert len(sizes) > 70 and sizes.max() > 30
    for tile, few in ((512, 1 << 20), (16, 0)):
        monkeypatch.setattr(parity_join, "TILE", tile)
        monkeypatch.setattr(stars, "FEW", few)
        assert {r.doc_id: r.component_id for r in parity_join.join(documents(spark, rows).repartition(6)).collect()} == want


def test_parity_join_empty(spark):
    assert parity_join.join(documents(spark, [])).count() == 0


def test_pigeonhole_holds():
    """Sets that reach the similarity always share a key."""
    rule, rng = parity_join.Rule(4, 85, 100), np.random.default_rng(0)
    edges = rule.bands()
    for _ in range(400):
        n = int(rng.integers(1, 600))
        a = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        lost = int(rng.integers(0, n * 15 // 100 + 1))
        b = np.sort(np.concatenate((rng.permutation(a)[lost:], rng.integers(0, 1 << 63, int(rng.integers(0, 2)), dtype=np.uint64))))
        shared = len(np.intersect1d(a, b))
        if len(b) and 100 * shared >= 85 * (len(a) + len(b) - shared):
            keys = [{int(k) for x in rule.instances(len(s), edges) for k in parity_join.block_keys(s, np.ones(len(s), np.int64), *x)} for s in (a, b)]
            assert keys[0] & keys[1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 201), (300, 200)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 0, 201: 200, 300: 200}


# ---------------------------------------------------------------- 10: substrings
def brute_substrings(rows, window=50):
    take = lambda t: [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    first = {}
    for i, t in rows:
        w = take(t)
        for j in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[j : j + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = take(t), set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone |= {*range(j, j + window)}
        out.append((str(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def test_substrings(spark, monkeypatch):
    a, b, c = words(1, 200), words(2, 200), words(3, 120)
    rows = [(1, " ".join(a)), (2, " ".join(b[:30] + a[50:120] + b[30:])), (3, " ".join(a)), (4, " ".join(c + a[:49])), (5, " ".join(a[:50] + c)), (6, " ".join(b[10:100] + a[60:130] + c[:60])), (7, " ".join(["same"] * 300)), (8, " ".join(["same"] * 60))]
    rows += [*ODD, (20, LONG + " end"), (21, " ".join(words(99, 30_000)[20_000:20_120]))]
    rng = np.random.default_rng(8)
    for i in range(30, 90):  # patchworks of a few sources, so that windows run over borders that several documents share
        parts = [(a, b, c)[int(rng.integers(3))] for _ in range(4)]
        cuts = [(p, int(rng.integers(0, 60)), int(rng.integers(60, 121))) for p in parts]
        rows.append((i, " ".join(x for p, u, v in cuts for x in p[u:v])))
    docs = documents(spark, rows, True)
    got = substring_dedup.remove(substring_dedup.find(docs)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute_substrings(rows)
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", 0)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove(substring_dedup.find(docs)).collect()) == brute_substrings(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x])
    for r in got:
        made = np.frombuffer(r.factors, "<i8").reshape(-1, 4).tolist()
        assert bool(made) == (r.n_removed > 0)
        for start, size, origin, at in made:  # a factor is what stands at its place in its source, as far as it goes
            assert origin < r.doc_id and size >= 50 and any(x[start : start + size] == y[at : at + size] for x in texts[r.doc_id] for y in texts[origin] if len(x) == r.n_words)
    assert substring_dedup.remove(substring_dedup.find(documents(spark, []))).count() == 0


# ---------------------------------------------------------------- 3: neighbours
def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[700:760] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] * 24), (5080, [float("inf")] + [0.0] * 23), (None, [1.0] * 24), (5100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    got = lsh_forest.search(df, df.filter("vec_id % 20 == 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    full = x.astype(float)
    for q in range(0, 1500, 20):
        s = full @ full[q]
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        mine = sorted(by[q])
        assert [m[0] for m in mine] == [*range(1, 21)]
        assert all(abs(m[2] - s[m[1]]) < 1e-9 for m in mine)
        hits += len({m[1] for m in mine} & {*map(int, order)})
    assert hits / (75 * 20) >= 0.9
    assert {*by} == {*range(0, 1500, 20)}
    assert lsh_forest.search(df.limit(0), df.limit(0)).count() == 0


# ---------------------------------------------------------------- 4: urls
def test_urls(spark):
    urls = ["http://a.net/x", "https://www.example.NET/en/5?x", "http://example.net", "http://EXAMPLE.com/de/9#f", "http://notexample.com/de/9", "x.org/fr/1", None, "", "http://www.b.org/fr/7/8/9/10", "a://b://c/d", "http://fake-net/x", "ftp://net/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, "http://c.net/")] + [(100 + i, f"http://s.com/p/{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("tpl", F.lit("clash"))
    got = {(str(r.page_id), r.host, r.path): r for r in url_filter.judge(url_filter.templates(df)).collect()}

    def brute(u):
        host, path = (lambda m: (m[1].lower(), m[2]) if m else ("", ""))(re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or ""))
        fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        return host, path, best.text if best else None, best.verdict if best else None

    for i, u in rows:
        host, path, rule, verdict = brute(u)
        r = got[str(i), host, path]
        assert r.rule == rule and (verdict is None or r.verdict == verdict)
    assert {r.template for r in got.values() if r.host == "s.com"} == {"/p/*"}
    assert url_filter.judge(url_filter.templates(df.limit(0))).count() == 0


def test_url_templates_are_rejected_by_purity(spark):
    rows = [(i, f"http://spam.test/go/{i}") for i in range(30)] + [(100 + i, f"http://good.test/art/{i}") for i in range(30)]
    rules = (url_filter.UrlRule("spam.test", "/go/1", "block"), url_filter.UrlRule("spam.test", "/go/2", "block"), url_filter.UrlRule("good.test", "/art/1", "allow"))
    got = {r.page_id: r.verdict for r in url_filter.judge(url_filter.templates(spark.createDataFrame(rows, "page_id long, url string"), rules), 0.8).collect()}
    assert all(got[i] == "block" for i in range(30)) and all(got[100 + i] == "allow" for i in range(30))


def test_url_nodes_keep_frequent_children_however_many(spark):
    sections = ["de", "en", "fr", "news", *(f"part-{c}" for c in "abcdefghijklmnopqrst")]
    urls = [f"http://www.example.com/{s}/{i}" for s in sections for i in range(20)] + [f"http://www.example.com/once-{c}" for c in "abcdefghijklmnop"]
    df = spark.createDataFrame(list(enumerate([*urls, *(f"http://a.org/fr/{i}" for i in range(20))])), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(url_filter.templates(df)).collect()}
    for i, u in enumerate(urls):
        section = u.split("/")[3]
        # sections without labels whose pages look alike are one branch; the labelled one is not
        assert got[i].template == {"de": "/de/*"}.get(section, "/*" if section.startswith("once") else "/^/*") and got[i].verdict == ("block" if section == "de" else "allow"), u
    apart = [f"http://www.example.com/{s}/{s}-page/{i}" for s in sections for i in range(20)]
    got = url_filter.judge(url_filter.templates(spark.createDataFrame(list(enumerate(apart)), "page_id long, url string"))).collect()
    assert {r.template for r in got} == {f"/{s}/{s}-page/*" for s in sections}


def test_url_templates_without_labels_are_allowed(spark):
    urls = [f"http://hot.net/en/{i}" for i in range(200)] + ["http://a.example.net/en/1"] + [f"http://clean.com/{s}/{i}" for s in ("en", "news") for i in range(20)]
    got = url_filter.judge(url_filter.templates(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))).collect()
    assert {(r.host, r.verdict) for r in got} == {("hot.net", "block"), ("a.example.net", "allow"), ("clean.com", "allow")}


def test_url_templates_are_as_deep_as_paths(spark):
    deep = "/".join("abcdefgh")
    urls = [f"http://x.test/{deep}/{kind}/{i}/z" for kind in ("spam", "news") for i in range(20)] + ["http://one.test/a/b/c/d/7/e"] + ["http://same.test/a/b/c/d/e/f"] * 20
    rules = (url_filter.UrlRule("x.test", f"/{deep}/spam/1", "block"),)
    got = url_filter.judge(url_filter.templates(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)).collect()
    assert len(got) == len(urls)
    assert {(r.template, r.verdict) for r in got} == {(f"/{deep}/spam/*/z", "block"), (f"/{deep}/news/*/z", "allow"), ("/a/b/c/d/*/e", "allow"), ("/a/b/c/d/e/f", "allow")}


def brute_tree(urls, rules):
    """template, purity of each url, by recursion over lists."""
    U = url_filter

    def split(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    def verdict(host, path):
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: (len(r.text), r.text)).verdict if fit else None

    rows, out = [], {}
    for i, u in enumerate(urls):
        host, path = split(u)
        rows.append((i, host, ["*" if re.search(U.VARIABLE, x) else x for x in path.split("/") if x], verdict(host, path)))
    count = lambda own: (len(own), sum(r[3] is not None for r in own), sum(r[3] == "block" for r in own))

    def handed(own, prior):
        n, lab, blk = count(own)
        return U.NEUTRAL + ((blk + U.PRIOR * prior) / (lab + U.PRIOR) - U.NEUTRAL) * lab / n

    def leaf(own, tpl, prior):
        _, lab, blk = count(own)
        out.update({r[0]: (tpl, (blk + U.PRIOR * prior) / (lab + U.PRIOR)) for r in own})

    def by(own, key):
        groups = {}
        for r in own:
            groups.setdefault(key(r), []).append(r)
        return groups

    def grow(own, tpl, level, prior):
        leaves = [r for r in own if len(r[2]) == level]
        if leaves:
            leaf(leaves, tpl[0], tpl[1])
        own = [r for r in own if len(r[2]) > level]
        if not own:
            return
        if len(own) < U.FEW or len({tuple(r[2][level:]) for r in own}) == 1:
            for rest, part in by(own, lambda r: "/".join(r[2][level:])).items():
                leaf(part, f"{tpl[0]}/{rest}", prior)
            return
        kids = by(own, lambda r: r[2][level])
        rare = {k for k, v in kids.items() if len(v) < U.FEW}
        rare_rows = sum(len(kids[k]) for k in rare)
        plain = [k for k in kids if k not in rare and not count(kids[k])[1]]
        after = lambda r: r[2][level + 1] if len(r[2]) > level + 1 else ""
        names = {}
        for k, v in kids.items():
            n, lab, blk = count(v)
            _, all_lab, all_blk = count(own)
            rest_lab, rest_blk = all_lab - lab, all_blk - blk
            names[k] = k
            if k in rare and rare_rows >= U.FEW and 2 * len(rare) > rare_rows:
                names[k] = "*"
            elif lab >= U.LABELLED and rest_lab >= U.LABELLED and abs(blk / lab - rest_blk / rest_lab) <= U.ALIKE * ((all_blk / all_lab) * (1 - all_blk / all_lab) * (1 / lab + 1 / rest_lab)) ** 0.5:
                names[k] = "~"
            elif k in plain and len(plain) > 1:
                others = by([r for o in plain if o != k for r in kids[o]], after)
                m = sum(map(len, others.values()))
                if sum(min(len(part) / n, len(others.get(x, [])) / m) for x, part in by(v, after).items()) >= U.OVERLAP:
                    names[k] = "^"
        for name, part in by(own, lambda r: names[r[2][level]]).items():
            grow(part, (f"{tpl[0]}/{name}", prior), level + 1, handed(part, prior))

    for own in by(rows, lambda r: r[1]).values():
        top = handed(own, U.NEUTRAL)
        grow(own, ("", top), 0, top)
    return out


def test_url_tree_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pick = lambda *names: names[int(rng.integers(len(names)))]
    urls = [None, "", "no scheme", "http://a.test", *(f"http://a.test/{'/'.join('abcdefghij')}/{i % 3}/x" for i in range(12))]
    for i in range(700):
        host = pick("a.test", "a.test", "b.a.test", "c.test")
        path = [pick("de", "en", "fr", "fr", "news", "go", f"slug-{chr(97 + i % 26)}{chr(97 + i // 26)}")]
        path += [pick("x", "y", str(i), f"w{chr(97 + i % 26)}") for _ in range(int(rng.integers(0, 5)))]
        urls.append(f"http://{host}/{'/'.join(path)}" + pick("", "/", "?q=1", "#f"))
    urls += [f"http://d.test/go/{i}" for i in range(80)] + ["http://d.test/other/1", "http://d.test/"]  # nearly all of a host is labelled and blocked
    rules = (url_filter.UrlRule("test", "/de/", "block"), url_filter.UrlRule("d.test", "/go/", "block"), url_filter.UrlRule("a.test", "/go/", "block"), url_filter.UrlRule("c.test", "/", "block"), url_filter.UrlRule("c.test", "/en/", "allow"), url_filter.UrlRule("a.test", "/fr/x", "allow"))
    want = brute_tree(urls, rules)
    got = {r.page_id: r for r in url_filter.judge(url_filter.templates(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)).collect()}
    assert {i: (r.template, round(r.purity, 9)) for i, r in got.items()} == {i: (t, round(p, 9)) for i, (t, p) in want.items()}
    free = {r.template: round(r.purity, 3) for r in got.values() if r.rule is None}
    assert len(set(free.values())) > 5 and any("^" in t for t in free) and {r.verdict for r in got.values() if r.rule is None} == {"allow", "block"}
    assert all((r.verdict == "block") == (r.purity >= url_filter.REJECT) for r in got.values() if r.rule is None)


# ---------------------------------------------------------------- 5, 8: classifiers
def test_languages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(df.filter("doc_id % 3 > 0"))
    got = language.predict(df, model).join(df.filter("doc_id % 3 = 0").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    odd = {str(r.doc_id): r for r in language.predict(documents(spark, [(1, None), (2, ""), (3, "123 ..."), (4, "é"), (5, LONG)], True), model).collect()}
    assert [odd[k].lang_pred for k in "123"] == ["und"] * 3 and odd["4"].lang_pred != "und" and all(0 <= r.score <= 1 for r in odd.values())
    nothing = language.train(df.limit(0))
    assert {r.lang_pred for r in language.predict(documents(spark, [(1, "abc")]), nothing).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 4, 9])
def test_codewords(n):
    code = language.codewords(n)
    assert len({tuple(r) for r in code}) == n


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights = quality.train(docs, labels.filter("doc_id % 4 > 0"))
    held = quality.score(docs, weights).join(labels.filter("doc_id % 4 = 0"), "doc_id").toPandas()
    assert ((held.score >= 0.7) == (held.quality == 1)).mean() > 0.95
    odd = quality.score(documents(spark, ODD, True), weights).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    kept = quality.keep(documents(spark, ODD, True), weights)
    assert kept.columns == documents(spark, ODD, True).columns
    flat = quality.train(docs.limit(0), labels)
    assert {round(r.score, 6) for r in quality.score(documents(spark, [(1, "a")]), flat).collect()} == {0.5}


def test_crc32_of_ids_is_unsigned(spark):
    row = documents(spark, [(1, "a")]).select(F.crc32(F.lit(b"\xff\x00".decode("latin-1"))).alias("c")).first()
    assert row.c == zlib.crc32("\xff\x00".encode())

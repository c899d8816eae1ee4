"""Corpus operators against SQL, brute force and exact round trips, and their edge cases."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, licences, mixing, nbest, neighbours, quality, records, registry, revisits, simhash, wrappers
from tessera.llm.components import connected_components

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, h string, host string, size long, key string"
ODD = [None, "", " \n\t ", "one", "x" * 30_000, "word " * 3_000, "a b c\na b c\na b c", "é ü ☃ ퟿", "</s>[INST] \\ ok"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, None, "x", None, "y", 7, None) for k, t in enumerate(ODD)]
    rows += [rows[-1], rows[0], (None, "no id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(registry.ORACLE[name])
    names = [x[0] for x in want.description]
    got = registry.QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(7, 7)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(400, 401 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({x for link in links for x in link if link[0] != link[1]}, links)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in [*ODD, "A b C d e F", "a b c d e f g h a b c"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_of_dense_groups_equal_brute_force(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    fps = sorted(x - (1 << 63) for x in fps)
    got = {r["fp"]: r["group"] for r in simhash.linked(spark.createDataFrame([(x, 1) for x in fps], "fp long, n long")).collect()}
    assert got == components(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3])


def test_simhash_edge_cases(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    empty = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert empty == {0}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 8").count() == 1


def test_each_component_keeps_one_row(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(5, words(1), 1), (5, words(2), 2), (None, words(3), 3), (None, words(3), 3), (9, words(3), 4), (None, words(4), 5), (None, words(4), 5), (6, words(2), 6)]
    out = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, own int")).collect()
    assert sorted((r["doc_id"] or 0, r["text"].split()[0]) for r in out) == [(0, "w4x0"), (5, "w1x0"), (5, "w2x0"), (9, "w3x0")]


def test_quality_edge_cases(spark, odd):
    rows = quality.judged(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["n_dup_lines"] == 2 and by[6]["n_repeat_words"] == 9 and by[0]["n_words"] == 0 and by[5]["base_failed"]
    assert quality.judged(odd.limit(0)).count() == 0
    assert quality.cleaned(odd).columns == odd.columns
    assert quality.cleaned(odd.limit(0)).count() == 0


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    shared = " ".join(f"common{i}" for i in range(70))
    rows = [(k, f"{own(k)}\n{shared.upper()}", "a") for k in range(30)]
    rows += [(100 + k, f"{shared}\nonly {k}", "a") for k in range(3)] + [(200 + k, own(999), "a") for k in range(40)] + [(300, shared, "b")]
    out = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[k]["kept"] and out[k]["n_removed_words"] == 70 for k in range(30))
    assert not any(out[100 + k]["kept"] for k in range(3))
    assert not any(out[200 + k]["kept"] for k in range(40)) and out[300]["kept"]  # 40 documents of one text; another host
    kept = {r["doc_id"]: r["text"] for r in quality.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept == {**{k: own(k) for k in range(30)}, 300: shared}  # the line is gone from every text that stays
    once = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string"), copies_once=True).collect()}
    assert all(once[200 + k]["kept"] for k in range(40)) and all(once[k]["kept"] == out[k]["kept"] for k in out if k < 200)


def test_lines_are_counted_by_documents(spark):
    rows = [(7, "one line of a document\n" + " ".join(f"w{i}" for i in range(60)), "a")] * 50 + [(k, f"common line\n{' '.join(f'x{k}y{i}' for i in range(60))}", "b") for k in range(21)]
    out = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r["n_removed_lines"] == (0 if r["doc_id"] == 7 and r["n_words"] == 65 else 1) for r in out) and len(out) == 71


def test_depleted_documents_of_a_hot_host_are_rejected(spark):
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    shared = " ".join(f"common{i}" for i in range(70))
    rows = [(k, f"{own(k)}\n{shared}" if k < 40 else own(k), "a") for k in range(300)] + [(1000, f"{shared}\nonly", "a")]
    out = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[1000]["kept"] is False and not out[1000]["base_failed"] and all(out[k]["kept"] for k in range(300))


def test_mixing_meets_targets(spark, odd):
    rows = [(s * 1000 + k, "w " * (k % 9 + 1), f"s{s}") for s in range(5) for k in range(200 if s else 4)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in range(5):
        own = [r for r in out if r["source"] == f"s{s}"]
        assert sum(r["taken"] for r in own) == int(own[0]["target"]) <= 3 * own[0]["source_size"]
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(odd.limit(0)).count() == 0
    assert mixing.sampled(odd).columns == odd.columns


def test_repeated_rows_at_a_budget_edge(spark):
    rows = [(5, "w " * 50, "a", 1, "p")] * 9 + [(k, "v " * 20, "b", 2, "q") for k in range(9)] + [(None, "u " * 7, None, 3, "r")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _take int, parts string")
    plan = {r["source"]: r["n"] for r in mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    out = mixing.sampled(docs)
    got = {}
    for r in out.collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    assert out.columns == docs.columns and got == plan and plan["a"] % 50


def test_quality_weights_are_an_argument(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "ab"[k % 2], float(k < 200)) for k in range(400)], "doc_id long, text string, source string, q double")
    out = mixing.mixed(docs, quality=F.col("q")).where("source = 'b'").groupBy(F.col("doc_id") < 200).agg(F.sum("part").alias("n")).collect()
    good, bad = (next(r["n"] for r in out if r[0] is x) for x in (True, False))
    assert good > 4 * bad


def test_mix_rows_hold_the_words_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {r["source"]: r["n"] for r in mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    rows = mixing.sampled(docs).collect()
    for source, n in plan.items():
        assert sum(len(r["text"].encode().split()) for r in rows if r["source"] == source) == n


def test_records_round_trip(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = odd.union(odd.limit(1).select(F.lit(70).alias("doc_id"), F.lit("a <|endoftext|> b<|endoftext|>c"), *odd.columns[2:]))
    manifest = records.write(odd, path, f"file://{tmp_path}", shards=5)
    assert records.read(manifest).select(F.spark_partition_id().alias("p"), "shard").distinct().groupBy("p").count().where("count > 1").count() == 0
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in records.indexed(manifest).collect()), key=lambda x: x[2])
    assert [x[:2] for x in got] == sorted(x[:2] for x in got)
    texts, at = {}, 0
    for r in odd.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        texts.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for has, doc_id, start, n, crc in got:
        assert start == at and (n, crc) in texts[doc_id if has else None]
        at += n
    first = manifest.orderBy("shard").first()
    assert records.read_record(first["path"], 0)[0] is None
    assert records.write(odd.limit(0), path, f"file://{tmp_path}").count() == 0


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = P.path(name)
        encoder, plain, library = records.Encoder(path), records.Encoder(path, plain=True), Tokenizer.from_file(path)
        texts = ["Some words here.", "a <|endoftext|> b", "x" * 300, ""]
        ids = [np.frombuffer(x, f"<u{encoder.width}").tolist() for x in encoder.encode(texts)]
        assert ids == [library.encode(x, add_special_tokens=False).ids for x in texts]
        assert encoder.cuttable == name.startswith("byte") and len(plain.encode(texts)[1]) > len(encoder.encode(texts)[1])
        assert all(len(x) <= records.REMEMBERED for x in encoder.memory)


def test_broken_records_are_noticed():
    frame = records.framed(b"payload")
    for k in range(len(frame)):
        bad = bytearray(frame)
        bad[k] ^= 4
        with pytest.raises((ValueError, OverflowError, MemoryError)):
            import io

            records.unframed(io.BytesIO(bytes(bad)).read)


def test_pieces_of_texts_encode_as_the_whole():
    encoder = records.Encoder.at(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "Ab", " ", "'s", "\n", "é", "1", ".", "☃", "\t", " ", "the"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_n_best_equals_brute_force():
    pieces = nbest.Pieces.at(P.path("piece_bpe_32k.model"))

    def every(text):
        text, out = "▁" + text.replace(" ", "▁"), []

        def go(at, score):
            if at == len(text):
                out.append(score)
            for end, more, _ in pieces.edges(text, at) if at < len(text) else ():
                go(end, score + more)

        go(0, 0.0)
        return sorted(out, reverse=True)

    rng = random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice("the aion\nré☃x") for _ in range(rng.randint(1, 10)))
        found, want = pieces.encode(text, 5), every(text)
        assert len(found) == len({raw for _, raw in found}) == min(5, len(want))
        assert np.allclose([s for s, _ in found], want[:5])
        assert all(pieces.decode(np.frombuffer(raw, "<i4").tolist()) == text for _, raw in found)


def test_long_segments_and_ties():
    pieces = nbest.Pieces.at(P.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    for text in ("a" * 100_000, "".join(rng.choice("abcdefghij☃") for _ in range(100_000)), "ab " * 50_000):
        found, sound, _ = pieces.searched(text, 4)
        assert sound and len({raw for _, raw in found}) == 4
        assert all(pieces.decode(np.frombuffer(raw, "<i4").tolist()) == text for _, raw in found)
        assert sorted((s for s, _ in found), reverse=True) == [s for s, _ in found]
    assert all(len(x) <= nbest.REMEMBERED for x in pieces.memory)


def test_space_marks_in_a_text_are_reported():
    assert nbest.Pieces.at(P.path("piece_bpe_32k.model")).searched("a▁b", 2)[1] is False


def test_other_vocabularies_are_not_cut():
    pieces = nbest.Pieces(P.path("piece_bpe_32k.model"))
    pieces.cuttable = False
    for text in ("the cat sat on the mat", "a\nb  c", ""):
        whole = nbest.Pieces.at(P.path("piece_bpe_32k.model")).encode(text, 4)
        assert np.allclose([s for s, _ in pieces.encode(text, 4)], [s for s, _ in whole])


def test_n_best_edge_cases(spark, odd):
    docs = odd.withColumn("ids", F.lit("own")).withColumn("Scores", F.lit(1))
    out = nbest.encoded(docs, P.path("piece_bpe_32k.model"))
    lists = F.transform("others", lambda p: nbest.patched(F.col("_ids"), p))
    rows = out.withColumn("lists", lists).collect()
    assert out.columns[-8:] == ["ids", "Scores", "_ids", "n_pieces", "others", "_scores", "crcs", "decoded"]
    assert len(rows) == odd.count() and all(r["decoded"] and r["ids"] == "own" for r in rows)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    pieces = nbest.Pieces.at(P.path("piece_bpe_32k.model"))
    for r in rows:
        lists = [r["_ids"], *r["lists"]]
        assert [zlib.crc32(np.array(x, "<i4").tobytes()) for x in lists] == r["crcs"] and len(lists) == len(r["_scores"])
        assert r["doc_id"] is None or all(pieces.decode(x) == texts[r["doc_id"]] for x in lists if x)


def test_fractional_scores_are_exact():
    pieces = nbest.Pieces(P.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    scale = 1 << 40
    pieces.unit, pieces.penalty = scale, int(pieces.penalty * scale)
    pieces.ids = {x: (i, s * scale - rng.randrange(1, 9)) for x, (i, s) in pieces.ids.items()}  # differences far below any rounding
    pieces.known = dict.fromkeys(pieces.prefixes) | {x: (i.to_bytes(4, "little"), s) for x, (i, s) in pieces.ids.items()}
    for text in ("the nation", "ab ab cd", "on a ration"):
        every = pieces.n_best("▁" + text.replace(" ", "▁"), 6)
        assert [s for s, _ in every] == sorted((s for s, _ in every), reverse=True) and len({s for s, _ in every}) > 1
        assert [s for s, _ in pieces.encode(text, 6)] == [s / scale for s, _ in every]


def test_licence_automata():
    mit = licences.TEMPLATES[0][1].replace("<<var;limit=3>>", '"Software"').replace("<<var;limit=12>>", "THE AUTHORS")
    with_option = mit.replace("<<beginOptional>>", "").replace("<<endOptional>>", "")
    without = licences.re.sub("<<beginOptional>>.*?<<endOptional>>", "", mit)
    for text in (with_option, without, f"before {without.upper()} after"):
        assert "mit" in licences.scan(text)[5].split(",")
    assert "mit" not in licences.scan(without.replace("sublicense", "sell"))[5].split(",")
    assert licences.scan("x CC-BY y cc by 4 All rights, reserved")[:6] == (10, 3, 1, 7, "cc-by,reserved", "cc-by,reserved")
    assert licences.scan(None) == (0, 0, None, None, "", "", 0.0)


def expansions(template, filler):
    """Every word sequence that a short template accepts, replaceable regions filled with any words of filler."""
    parts = [[]]
    tokens = [x for x in licences.re.split(r"(<<.*?>>)", template) if x]

    def build(k, stop):
        out = [()]
        while k < len(tokens) and tokens[k] != stop:
            x = tokens[k]
            if x == "<<beginOptional>>":
                inner, k = build(k + 1, "<<endOptional>>")
                more = [(), *inner]
            elif x.startswith("<<var"):
                limit = int(x.split("=")[1][:-2])
                more = [fill for n in range(limit + 1) for fill in itertools.product(filler, repeat=n)]
            else:
                more = [tuple(licences.words_of(x))]
            out = [a + b for a in out for b in more]
            k += 1
        return out, k

    parts, _ = build(0, None)
    return set(parts)


def test_automata_equal_expansions():
    rng = random.Random(6)
    for _ in range(120):
        body = "".join(
            rng.choice(["a ", "b ", "c ", "<<var;limit=1>> ", "<<var;limit=2>> ", "<<beginOptional>>a <<endOptional>> ", "<<beginOptional>>b <<beginOptional>>c <<endOptional>> <<endOptional>> ", "<<beginOptional>>c <<var;limit=1>> <<endOptional>> "])
            for _ in range(rng.randint(1, 3))
        )
        template = f"x y z {body}"
        automaton, accepted = licences.Automaton(template), expansions(template, "abc")
        for _ in range(40):
            words = ["x", "y", "z", *(rng.choice("abcc") for _ in range(rng.randrange(6)))]
            ends = [k for k in range(len(words) + 1) if tuple(words[:k]) in accepted]
            assert automaton.end(words, 0) == (ends[0] if ends else None), (template, words)


def test_notices_add_labels():
    assert licences.scan("Released under the MIT License.")[4:6] == ("", "mit-notice")
    assert licences.scan("x Licensed under the Apache License, Version 2.0. y")[4:6] == ("", "apache-notice")
    assert licences.scan("Licensed under CC BY-NC 4.0.")[4:6] == ("cc-by", "cc-by,cc-by-nc")


def test_licence_edge_cases(spark, odd):
    long = "word " * 40_000 + licences.TEMPLATES[0][1].replace("<<var;limit=3>>", "S").replace("<<var;limit=12>>", "A")
    more = odd.limit(1).select(F.lit(80).alias("doc_id"), F.lit(licences.re.sub("<<.*?>>", "", long)), *odd.columns[2:])
    rows = licences.scanned(odd.union(more)).collect()
    assert len(rows) == odd.count() + 1
    assert all(r["labels"] == "" and r["score"] == 0 and r["first_word"] is None for r in rows if r["doc_id"] != 80)
    assert next(r["labels"] for r in rows if r["doc_id"] == 80) == "mit,mit-grant"
    assert licences.scanned(odd.limit(0)).count() == 0


def page(nav, body, more=""):
    return f"<html><head><title>t</title></head><body><nav>{nav}</nav>{body}{more}<footer>f</footer></body></html>"


def test_wrappers(spark):
    rows = [
        (0, "http://a.x/1", page("<a>m</a>", "<article><h1>T &amp; t</h1><p>one<br>two<p>three</article>")),
        (1, "http://A.x/2", page("<ul><li>m<li>n</ul>", "<article><p>only</p><aside>side</aside></article>", "<div class='cookie-notice'>c</div>")),
        (2, "http://b.x/1", "<body><div id='content'><p>kept  text</p></div><div class='comments'><p>no</p></div><form>q</form></body>"),
        (3, None, None),
        (4, "http://c.x", "bare <script>no</script>text"),
        (4, "http://c.x", "bare <script>no</script>text"),
        (5, "http://a.x/3", page("m", "<div><p>no article here</p></div>")),
        (6, "http://a.x/4", page("m", "<article></article>", "<div><p>beside</p></div>")),
        (7, "http://d.x", "<div>" * 3000 + "deep" + "</div>" * 3000 + "<nav>m</nav>after"),
    ]
    out = wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in out}
    assert len(out) == 9
    assert texts == {0: "T & t\n\none two\n\nthree", 1: "only", 2: "kept text", 3: "", 4: "bare text", 5: "no article here", 6: "", 7: "deep\n\nafter"}


def test_texts_fixed_on_a_host_are_no_main_text(spark):
    def own(k):
        side = "<section><p>Read on paper</p></section>" if k % 2 else ""
        return f"<body><div><p>All rights reserved</p></div><div><p>own {k}</p><p>more {k}</p><p>Send to a friend</p></div>{side}</body>"

    def run(rows):
        return {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    whole = "All rights reserved\n\nown {0}\n\nmore {0}\n\nSend to a friend"
    alone = run([(0, "http://a.x/0", own(0)), (2, "http://b.x/0", own(2)), *((100 + k, "http://a.x/copy", own(0)) for k in range(9))])
    assert alone == {k: whole.format(2 if k == 2 else 0) for k in alone}  # copies of one page tell nothing
    many = run([(k, f"http://a.x/{k}", own(k)) for k in range(12)] + [(50, "http://b.x/", own(50))])
    assert many == {**{k: f"own {k}\n\nmore {k}" for k in range(12)}, 50: whole.format(50)}
    mixed = run([(k, f"http://a.x/{k}", own(k)) for k in range(12)] + [(60, "http://a.x/60", "<body><div><p>other</p></div></body>")])
    assert mixed[60] == "other"


def test_nothing_inside_an_article_is_fixed(spark):
    same = [(k, f"http://a.x/{k}", f"<body><div>stamp {k}</div><article><h1>One story</h1><p>told again</p></article></body>") for k in range(6)]
    begun = [(10 + k, f"http://b.x/{k}", f"<body><main><p>Weekly report</p><p>By Staff</p><p>news {k}</p></main><div>Share</div></body>") for k in range(6)]
    out = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(same + begun, "page_id long, url string, html string")).collect()}
    assert out == {**{k: "One story\n\ntold again" for k in range(6)}, **{10 + k: f"Weekly report\n\nBy Staff\n\nnews {k}" for k in range(6)}}


def test_class_names_and_depth_do_not_lose_articles():
    def text(html):
        return wrappers.main_text(html, wrappers.regions(wrappers.own_wrapper(wrappers.tree(html))))

    for begin, end in (("<body class='has-sidebar'>", ""), ("<body class='search-enabled header-fixed'>", ""), ("<main class='with-ads'>", "</main>"), ("<div class='content no-comments'>", "</div>")):
        assert text(f"{begin}<article class='post no-comments'><p>kept</p></article>{end}") == "kept"
    assert text("<article title='The hidden valley' data-class='ad'><p>kept</p></article>") == "kept"
    for gone in ("<p hidden>x</p>", "<p aria-hidden=true>x</p>", "<p style='display: none'>x</p>", "<div class='cookie-notice'>x</div>", "<div class='widget_recent'>x</div>", "<div class='site-footer'>x</div>", "<div class='ad-300x250'>x</div>"):
        assert text(f"<body>{gone}<p>kept</p></body>") == "kept"
    deep, back = "<div>" * 300, "</div>" * 300
    assert text(f"{deep}<nav><ul><li>m<li>n</ul></nav>kept<form>q</form>{back}after") == "kept\n\nafter"
    assert text(f"{deep}<article><div>kept<aside>side</aside></div></article>beside{back}after") == "kept"


def test_wrappers_accept_every_page_they_were_inferred_from():
    rng = random.Random(1)

    def content(depth=0):
        out = []
        for _ in range(rng.randrange(4)):
            if rng.random() < 0.35 and not (out and isinstance(out[-1], str)):
                out.append(rng.choice("xyz"))
            elif depth < 2:
                out.append([rng.choice("ab"), content(depth + 1)])
        return out

    for _ in range(1500):
        pages = [["", content()] for _ in range(rng.randint(1, 4))]
        wrapper = wrappers.own_wrapper(pages[0])
        for page in pages[1:]:
            wrapper = wrappers.aligned(wrapper, wrappers.own_wrapper(page))
        pattern = licences.re.compile(wrappers.expression(wrapper))
        assert all(pattern.fullmatch(wrappers.stream(page)) for page in pages)


def test_names_that_say_nothing_leave_it_to_the_wrapper(spark):
    def own(k):
        extra = "<ul><li>Jobs</ul>" if k % 3 else ""
        return f"<body><div class=q7><p>Home</p>{extra}<p>Products</p></div><div class=zz><p>story {k}</p><p>ends {k}</p></div></body>"

    rows = [(k, f"http://a.x/{k}", own(k), "w", "h") for k in range(9)]
    out = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string, host string")).collect()}
    assert out == {k: f"story {k}\n\nends {k}" for k in range(9)}
    alone = wrappers.main_text(own(1), wrappers.regions(wrappers.own_wrapper(wrappers.tree(own(1)))))
    assert alone == "Home\n\nJobs\n\nProducts\n\nstory 1\n\nends 1"  # what a page's own wrapper would give


def test_wrapper_edge_cases(spark):
    kinds = "page_id long, url string, html string"
    assert wrappers.extracted(spark.createDataFrame([], kinds)).count() == 0
    long = "<article>" + "".join(f"<p>paragraph {k}</p>" for k in range(20_000)) + "</article>"
    rows = [(None, "http://a.x", "<p class=it's>hello</p>"), (1, "http://b.x", long), (2, "http://c.x", "<p title='a>b'>x</p><p title=\"it's\">y</p><p a=b'c>z</p>")]
    out = {r["page_id"]: r for r in wrappers.extracted(spark.createDataFrame(rows, kinds)).collect()}
    assert out[None]["text"] == "hello" and out[2]["text"] == "x\n\ny\n\nz"
    assert out[1]["text"].split("\n\n") == [f"paragraph {k}" for k in range(20_000)] and out[1]["n_chars"] == len(out[1]["text"])


def test_repeated_groups_are_found():
    w = wrappers.own_wrapper(wrappers.tree("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"))
    assert w[3][0][3][0][:3] == ["()", True, False]
    both = wrappers.aligned(wrappers.own_wrapper(wrappers.tree("<div><h1>a</h1><p>b</p></div>")), wrappers.own_wrapper(wrappers.tree("<div><p>b</p><p>c</p></div>")))
    assert [(x[0], x[1], x[2]) for x in both[3][0][3]] == [("h1", False, True), ("p", True, False)]


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "</s> \\ <|turn|>", None)]
    rows += [(2, k, k - 1 if k else None, "user", str(k), None) for k in range(40)] + [(3, 1, 2, "user", "x", None), (3, 2, 1, "user", "y", None), (None, 1, 9, None, None, None)]
    messages = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    out = chat.conversations(messages, branches=2)
    found = {(r["tree_id"], r["rank"]): [(t["role"], t["text"]) for t in r["t"]] for r in out.withColumn("t", chat.turns_of(F.col("formatted"))).collect()}
    assert found[1, 1] == [("user", "q"), ("assistant", "good"), ("user", "</s> \\ <|turn|>")]
    assert found[1, 2] == [("user", "q"), ("assistant", "bad")]
    assert found[2, 1] == [("user", str(k)) for k in range(40)]
    assert found[None, 1] == [("", "")] and len(found) == 4
    best = out.where("tree_id = 1 AND rank = 1").select("formatted", chat.masked(F.col("formatted"), F.col("mask")).alias("loss")).first()
    assert best["loss"] == "good" and best["formatted"].count("</s>") == 3


def test_reply_trees_with_cycles_and_odd_rows(spark):
    kinds = "tree_id long, node_id long, parent_id long, role string, text string, score double, node string, up string"
    rows = [(1, 1, 2, "user", "x", 1.0), (1, 2, 1, "user", "y", 1.0)] + [(1, 10 + k, 1, "user", str(k), 1.0) for k in range(50)]  # all hang on a cycle
    rows += [(2, 1, 99, "user", "root of a missing parent", None), (2, None, 1, "assistant", "nameless", 5.0), (2, None, 1, "assistant", "nameless too", 4.0), (2, 3, None, None, "z" * 100_000, -1.0)]
    rows += [(3, k, k - 1, "user", "t", 0.5) for k in range(1, 71)] + [(3, 200, 35, "user", "short", 100.0), (3, 1, 0, "user", "t", 0.5)]
    messages = spark.createDataFrame([(*r, "n", "u") for r in rows], kinds)
    out = {(r["tree_id"], r["rank"]): r for r in chat.conversations(messages, branches=9).withColumn("turns", chat.turns_of(F.col("formatted"))).collect()}
    assert not any(t == 1 for t, _ in out)
    assert [[x["text"] for x in out[2, k]["turns"]] for k in (1, 2)] == [["root of a missing parent", "nameless"], ["root of a missing parent", "nameless too"]]
    assert out[2, 3]["turns"][0]["text"] == "z" * 100_000 and out[2, 1]["of"] == 3
    assert [(out[3, k]["leaf"], len(out[3, k]["turns"]), out[3, k]["total"]) for k in (1, 2)] == [(200, 36, 117.5), (70, 70, 35.0)]
    nodes = spark.createDataFrame([(1, 1, 2), (1, 2, 1), *((1, 10 + k, 1) for k in range(50))], "t long, key long, up long").select(F.struct("t").alias("tree"), "key", "up", F.lit(1.0).alias("score"))
    reach, hops = chat.reaches(nodes)
    assert reach.count() == 0 and all(h.count() <= 52 for h in hops)  # never more rows than messages
    assert chat.conversations(messages.limit(0)).count() == 0


def test_reply_trees_query_digests(spark):
    row = chat.op3(spark, SF).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["loss_chars"] == len(text)


def test_revisits(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        (1, "http://www.A.com/x/?utm_source=q", 10, "response", 200, h(ETag='"1"', Content_Length="9", Date="d1"), "one"),
        (2, "https://a.com/x#f", 20, "response", 404, h(), "no"),
        (3, "https://a.com/x", 30, "revisit", 304, h(etag='W/"1"', content_length="0", date="d2"), None),
        (4, "https://a.com/x", 30, "response", 200, h(Last_Modified="m"), "two"),
        (5, "https://a.com/x", 40, "revisit", 304, h(last_modified="other"), None),
        (6, "https://a.com/x", 41, "revisit", 304, None, None),
        (7, "https://a.com/x", 5, "revisit", 304, h(etag='"1"'), None),
        (8, None, None, "revisit", 304, None, None),
        (6, "https://a.com/x", 41, "revisit", 304, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string")
    out = {r["record_id"]: r for r in revisits.resolved(df, slices=3).collect()}
    assert [(k, out[k]["outcome"], out[k]["target_id"]) for k in sorted(out)] == [(3, "resolved", 1), (5, "mismatch", 4), (6, "unvalidated", 4), (7, "missing", None), (8, "missing", None)]
    assert out[3]["headers"] == {"etag": '"1"', "content-length": "9", "date": "d2"}
    assert revisits.resolved(df, slices=3).count() == 6 and revisits.resolved(df.limit(0)).count() == 0


def test_neighbours_find_brute_force_results(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.op6(spark, SF).collect()}
    data = rows.collect()
    x, ids = np.array([r["embedding"] for r in data], float), [r["vec_id"] for r in data]
    want = set()
    for k, i in enumerate(ids):
        if i % 20 == 0:
            near = sorted(((-float(s), j) for s, j in zip(x @ x[k], ids, strict=True) if j != i))[:20]
            want |= {(i, j) for _, j in near}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


def test_neighbours_edge_cases(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(k, one) for k in range(30)] + [(40, None), (60, [0.0, 0.0, 0.0]), (80, [None, 1.0, 0.0]), (81, [float("nan"), 1.0, 0.0]), (82, [2.0, 0.0, 0.0]), (0, one), (None, one)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.nearest(df.where("vec_id % 20 = 0"), df).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in out if r["query_id"] == 0] == [82, *range(1, 20)]
    assert [r["vec_id"] for r in out if r["query_id"] == 20] == [82, *range(19)]
    assert {r["query_id"] for r in out} == {0, 20} and out[0]["score"] == 2.0
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("longest", [1.0, 100.0])
def test_neighbours_with_one_long_vector(spark, longest):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= longest
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df.where("vec_id % 30 = 0"), df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(got) == 100 and all(len(v) == 20 for v in got.values())
    hit = 0
    for q, v in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(v & set(np.argsort(-score)[:20].tolist()))
    assert hit >= 0.9 * 2000


def test_all_candidates_where_there_are_few(spark):
    x = np.random.default_rng(6).normal(size=(15, 64))
    df = spark.createDataFrame([(k, v.tolist(), 1, 2) for k, v in enumerate(x)], "vec_id long, embedding array<float>, range int, slice int")
    assert sorted(r["vec_id"] for r in neighbours.nearest(df.where("vec_id = 0"), df).collect()) == list(range(1, 15))
    assert {r["query_id"] for r in neighbours.nearest(df.where("vec_id % 5 = 0"), df).collect()} == {0, 5, 10}


def test_neighbours_do_not_depend_on_slices(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    some = [sorted(map(tuple, neighbours.nearest(df.where("vec_id % 50 = 0"), df, slice_bytes=b).collect())) for b in (1 << 15, 1 << 30)]
    assert some[0] == some[1]


def test_mix_does_not_depend_on_slots(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 40)), "s" if k % 3 else "t", rng.choice([0.05, 0.05, 0.5, 1.0])) for k in range(1500)] + [(7, "w w", "s", 1.0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    read = lambda: sorted(map(tuple, mixing.mixed(docs, quality=F.col("quality")).collect()))
    whole = read()
    monkeypatch.setattr(mixing.edges, "__defaults__", (3, 10))
    assert read() == whole
    sized = mixing.sizes(docs, "doc_id", "text", "source", F.col("quality"))
    ends = mixing.edges(sized, spark.createDataFrame([("s", 4000), ("t", 0)], "s string, budget long"), 3, 10).collect()
    assert len(ends) == 1
    keys = sorted((r["key"], r["size"]) for r in sized.where("source = 's'").collect())
    low, high, before = ends[0]["low"], ends[0]["high"], ends[0]["before"]
    inside = [n for k, n in keys if low <= k <= high]
    assert before == sum(n for k, n in keys if k < low) < 4000 <= before + sum(inside) and (len(inside) <= 10 or low == high)


def test_neighbours_are_found_however_few_axes_are_probed(spark):
    x = np.random.default_rng(5).normal(size=(400, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.nearest(df.where("vec_id % 20 = 0"), df, tables=1, probes=1)
    assert out.count() == 20 * 20


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    verdict = {r["doc_id"] for r in quality.judged(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == verdict
    single = corpus_pipeline.near_duplicates(spark, kept, SF).collect()
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in kept.collect()}
    roots = components(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {r["doc_id"] for r in single} == set(roots.values()) and len(single) == len(set(roots.values()))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("NOT decoded").count() == 0
    odd = docs.unionByName(docs.limit(20)).withColumns({c: F.lit(1) for c in ("ids", "scores", "_take", "_id", "row", "size", "own")})
    odd = odd.unionByName(odd.limit(5).withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string")))
    odd = odd.unionByName(odd.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(odd.limit(1).withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda x: F.concat(F.lit("w"), x.cast("string"))))))
    now = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, SF)
        assert now.count() > 0 and (k == 3 or now.columns == odd.columns)
    assert {"ids", "_ids", "scores", "_scores", "decoded"} <= set(now.columns) and now.where("NOT decoded").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0

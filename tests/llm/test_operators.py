"""Training-data operators against brute force, round trips, held-out labels, and edge cases."""

import hashlib
import itertools
import random
import re
from array import array

import pytest
from pyspark.sql import functions as F

from reuselens.llm import chat, common, decontamination, html_extract, license_scan, near_dedup, quality_classifier, quality_rules, sentencepiece_bpe, textstats, toxicity, url_filter
from reuselens.llm.common import held_out, training_rows
from reuselens.llm.components import components
from reuselens.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
SYLLABLES = "an be co de er fi go hu in ka lo me no pu ra so ti ur vo we".split()


def prose(r, n):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts], DOCS)


ODD = [(1, None), (None, "no id at all"), (3, ""), (4, " \n\t "), (5, "one"), (6, "same row"), (6, "same row"), (7, "x" * 50_000), (8, "word " * 20_000), (9, "ünïcödé ▁ ​ 漢字 😀\x00")]


def odd_docs(spark):
    """Nulls, blanks, long texts, repeated rows, and columns whose names an operator might use itself."""
    clash = "measured failed_rules score hits block_hits pieces kept s n key leader digest component_id row_number_of_id Measured_1".split()
    df = documents(spark, ODD)
    return df.select("*", *[F.lit("mine").alias(c) for c in clash])


def same_columns(df, docs):
    assert df.columns == docs.columns
    for r in df.collect():
        assert r["measured"] == r["score"] == r["kept"] == "mine"


def odd_labels(spark):
    return spark.createDataFrame([(None, 1, 1), (3, None, None), (5, 1, 0), (5, 0, 1), (8, 0, 0), (99, 1, 0)], LABELS)


# --- shared ----------------------------------------------------------------------------------------------------------


def brute_measure(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 2000 else None
    hit = {k + j for k, x in enumerate(windows) if twice and x in twice for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measurements():
    r = random.Random(3)
    texts = ["", None, "a", "a b", "a b c", "a b c a b c", "a\n\na\n \nb", "a|b\x0bc\x85d e", *(" ".join(r.choice("ab") for _ in range(n)) for n in range(30)), *(prose(r, n) + "\n" + prose(r, n) for n in range(40))]
    for t in texts:
        got = dict(zip(textstats.FIELDS, textstats.measure(None if t is None else t.encode()), strict=True))
        assert tuple(got[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_measure(t), t


def test_held_out_and_training_rows(spark):
    import zlib

    got = {r["id"]: r["h"] for r in spark.range(50).select("id", held_out("id").alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in range(50)}
    docs = documents(spark, [(k, f"t{k}") for k in range(50)])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)] + [(3, 0, 0), (None, 1, 1)], LABELS)
    rows = training_rows(docs, labels, "quality", 10).collect()
    assert len(rows) == 10 and not any(got[r["doc_id"]] for r in rows)
    assert training_rows(docs, labels.limit(0), "quality").count() == 0


@pytest.mark.parametrize("hot", [1_000, 8])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)  # joins of hot nodes too
    r = random.Random(5)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5), (None, 3)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in nodes}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 1 toxicity ------------------------------------------------------------------------------------------------------


def test_folding_and_exceptions():
    lexicon = toxicity.seeds()
    for bad in ("You idiot!", "1d10t", "уоu іdiоt", "$tup1d", "ＩＤＩＯＴ", "i​diot", "M0R0NS"):
        assert lexicon.density(bad)[1] == 1, bad
    for good in ("put it in the trash can", "he is not an idiot", "a clown fish", "", None, "identity 1010", "loses"):
        assert lexicon.density(good)[1] == 0, good
    assert lexicon.density("not an idiot but a moron")[1] == 1
    assert lexicon.density("idiot " + "fine " * 999)[0] < lexicon.density("idiot " + "fine " * 99)[0]


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        words = prose(r, 60).split()
        for _ in range(3 if bad else 0):
            words.insert(r.randrange(60), r.choice(["grumpf", "zorbelix", "zorbelam", "zorbelu"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    labels = spark.createDataFrame(labels, LABELS)
    got = toxicity.query(documents(spark, rows), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 100 and all(x["predicted"] == x["toxic"] and 0 <= x["score"] <= 1 for x in got)


def test_toxicity_edge_cases(spark):
    for labels in (odd_labels(spark), odd_labels(spark).limit(0)):
        got = toxicity.query(odd_docs(spark), labels).collect()
        assert len(got) == len(ODD) and all(x["predicted"] in (0, 1) and 0 <= x["score"] <= 1 for x in got)
    assert toxicity.query(documents(spark, []), odd_labels(spark)).count() == 0


def test_toxicity_of_empty_partitions(spark):
    r = random.Random(6)
    rows = [(k, prose(r, 30) + (" zorbelix zorbelam" if k % 2 else ""), k % 2) for k in range(30)]
    few = spark.createDataFrame(rows, "doc_id bigint, text string, y int").repartition(64).withColumn("seeded", F.lit(False))
    assert any(x.startswith(" zorb") for x in toxicity.learnt(few))
    assert toxicity.learnt(few.where("y = 0")) == toxicity.learnt(few.limit(0)) == {}


def test_toxicity_against_plain_search(spark):
    """Every entry is looked for at every word of the folded text, every phrase by its places."""
    lexicon, r = toxicity.seeds(), random.Random(8)
    vocabulary = "idiots trash can clown fish nose not an a moron loser sore stupid stupidity worthless proof trashcan fine scummy".split()
    for _ in range(300):
        words = r.choices(vocabulary, k=r.randint(0, 60))
        folded = " " + " ".join(toxicity.fold(" ".join(words)).split()) + " "
        spared = {(k, k + len(p)) for p in lexicon.exceptions for k in range(len(folded)) if folded.startswith(p, k)}
        total, n = 0.0, 0
        for k in range(len(folded)):
            w = max((w for x, w in lexicon.weights.items() if folded.startswith(x, k) and not any(a <= k and k + len(x) <= b for a, b in spared)), default=0)
            total, n = total + w, n + (w > 0)
        density, hits = lexicon.density(" ".join(words))
        assert hits == n and abs(density - total / max(20, len(words))) < 1e-12
    long = "not an idiot trash can " * 20_000 + "moron"
    assert lexicon.density(long)[1] == 1


def test_training_rows_are_bounded_by_rows(spark):
    docs = documents(spark, [(k % 2, f"text {k}") for k in range(2000)])
    labels = spark.createDataFrame([(k, 1, 1) for k in range(2)], LABELS)
    assert training_rows(docs, labels, "quality", 10).count() <= 2


# --- 2 quality rules -------------------------------------------------------------------------------------------------


def test_ledger_and_policies(spark):
    r = random.Random(2)
    docs = documents(spark, [(1, prose(r, 80)), (2, "few"), (3, "same three words " * 40), (4, prose(r, 80).replace(" ", "*** "))])
    got = {x["doc_id"]: x for x in quality_rules.query(docs).collect()}
    assert [got[k]["base_failed"] for k in (1, 2, 3, 4)] == [False, True, True, False]
    assert [got[k]["kept"] for k in (1, 2, 3, 4)] == [True, False, False, False]
    base = quality_rules.query(docs, quality_rules.POLICIES["base-1"]).where("kept").count()
    assert base == 2


def test_ablations(spark):
    book = spark.createDataFrame([(b,) for b in (0, 0, 1, 2, 3, 4, 1 << 20)], "failed_rules bigint")
    policy = quality_rules.Policy("t", ("few_words", "repeated_words", "symbols"))
    got = {x["rule"]: x for x in quality_rules.ablations(book, policy).collect()}
    assert {(x["n_rows"], x["n_failed"], x["n_alone"], x["n_kept_without"]) for x in [got["few_words"]]} == {(7, 2, 1, 4)}
    assert (got["symbols"]["n_failed"], got["symbols"]["n_alone"], got["symbols"]["n_kept_without"]) == (1, 1, 4)
    one = quality_rules.Policy("one", policy.rules, allowed=1)
    assert book.where(one.passes(F.col("failed_rules"))).count() == 6


def test_rules_edge_cases(spark):
    docs = odd_docs(spark)
    got = quality_rules.query(docs).collect()
    assert len(got) == len(ODD)
    for x, (_, t) in zip(sorted(got, key=lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["n_words"])), sorted(ODD, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        assert x["n_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    same_columns(quality_rules.keep(docs, quality_rules.Policy("none", ())), docs)
    assert quality_rules.keep(docs, quality_rules.Policy("none", ())).count() == len(ODD)
    assert quality_rules.query(documents(spark, [])).count() == 0


# --- 3 chat ----------------------------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_chat_round_trip(spark):
    r = random.Random(4)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "\\", "\\.", "[", "<", "/s>", " ", "x", "\n", "é", "[TEXT]", "[\\.INST]", "<s"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "[INST]", "", None]), r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(0, 12)))])) for c in range(60) for t in range(r.randint(1, 6))]
    got = {x["conv_id"]: x for x in chat.query(spark.createDataFrame(rows, TURNS).withColumn("turns", F.lit(1)).withColumn("segments", F.lit(1))).collect()}
    rows += [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    assert set(got) == {x[0] for x in rows}
    for c, x in got.items():
        turns = sorted((t, role or "", text or "") for k, t, role, text in rows if k == c)
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert x["n_turns"] == len(turns) and x["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert x["loss_chars"] == len(loss) and x["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_machine_and_output(spark):
    talk = lambda c, *roles: [(c, k, role, "t") for k, role in enumerate(roles)]
    rows = talk(1, "system", "user", "assistant") + talk(2, "user", "user") + talk(3, "assistant") + talk(4, "user", "assistant", "user") + talk(5, "user", "system", "user")
    out = chat.formatted(spark.createDataFrame(rows, TURNS)).orderBy("conv_id").collect()
    assert [(x["state"], x["error_turn"]) for x in out] == [("answered", None), ("error", 1), ("error", 0), ("asked", None), ("error", 1)]
    assert out[0]["text"] == "<s>[SYS] t [/SYS]</s><s>[INST] t [/INST]</s><s>[OUT] t</s>"
    assert "".join(s["text"] for s in out[0]["segments"]) == out[0]["text"] and [s["text"] for s in out[0]["segments"] if s["loss"]] == ["t"]
    assert chat.formatted(spark.createDataFrame([], TURNS)).count() == 0
    odd = chat.digests(spark.createDataFrame([(None, None, None, None), (None, 1, "user", "x"), (7, 0, "user", "y" * 300_000), (7, 0, "user", "y" * 300_000)], TURNS)).collect()
    assert sorted(x["n_turns"] for x in odd) == [2, 2]


def test_chat_is_native(spark):
    plan = chat.query(spark.createDataFrame([], TURNS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 4 SentencePiece -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def test_pieces_equal_the_library(library):
    bpe = sentencepiece_bpe.loaded(sentencepiece_bpe.model_bytes(tokenizer_path()))
    r = random.Random(6)
    bits = ["a", "b", "th", "ing", " ", "  ", "\n", "é", "漢", "▁", "​", "😀", "\t", "\x00", "1", "the", "      ", "<s>", "ᬓ", "́"]
    texts = ["", " ", " " * 70 + "x", "a" * 500, *(t or "" for _, t in ODD), *("".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(1500))]
    for t in texts:
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert bpe.encode(t) == array("I", ids).tobytes(), t[:80]
        assert bpe.decode(array("I", ids).tobytes()) == library.decode(ids), t[:80]


def test_decoding_any_ids(library):
    bpe = sentencepiece_bpe.loaded(sentencepiece_bpe.model_bytes(tokenizer_path()))
    r = random.Random(7)
    for _ in range(500):
        ids = [r.choice([1, 2, r.randint(3, 258), r.randint(3, 258), r.randint(259, 31_999)]) for _ in range(r.randint(0, 12))]
        assert bpe.decode(array("I", ids).tobytes()) == library.decode(ids), ids


def test_pieces_edge_cases(spark, library):
    got = sentencepiece_bpe.digests(odd_docs(spark), tokenizer_path()).collect()
    want = sorted((k or 0, len(library.encode(t or "", add_bos=True, add_eos=True))) for k, t in ODD)
    assert sorted((x["doc_id"] or 0, x["n_tokens"]) for x in got) == want
    assert sentencepiece_bpe.digests(documents(spark, []), tokenizer_path()).count() == 0
    full = sentencepiece_bpe.encode(documents(spark, [(1, "hello there")]), tokenizer_path()).first()["pieces"]
    assert full["decoded"] == "hello there" and len(full["ids"]) == 4 * full["n_tokens"]


# --- 5 URL filter ----------------------------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"


def link(u):
    return f'<html><head><link href="{u}" rel="canonical"></head>'


def test_url_rules_and_aliases(spark):
    rows = [
        (1, "http://a.net/x", None), (2, "http://net", ""), (3, "http://www.Example.NET/en/1?q", ""), (4, "http://example.net/english", ""), (5, "http://x.org/fr/1", ""), (6, "http://m.example.com/de/9", ""),
        (7, "http://free.org/en/1", link("http://A.net/x#top")), (8, "HTTP://Free.org/en/1#z", ""), (9, "http://alias.com/1", link("//two.com/2")),
        (10, "http://two.com/2", '<meta http-equiv="refresh" content="0; url=http://y.org/fr/2">'), (11, "http://three.com/3", link("http://a.net/x")), (12, "http://three.com/3#a", link("http://z.org/fr/1")),
        (13, None, None), (14, "no scheme", link("http://a.net/x")), (15, "://", ""), (16, "http://notnet/", ""), (1, "http://a.net/x", None),
    ]
    got = {x["page_id"]: x for x in url_filter.query(spark.createDataFrame(rows, PAGES).withColumn("alias", F.lit(1)).withColumn("component", F.lit(1))).collect()}
    rule = {k: x["rule"] for k, x in got.items()}
    assert rule == {1: "net/", 3: "example.net/en/", 4: "net/", 5: "org/fr/", 6: "example.com/de/"} | dict.fromkeys((2, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16))
    assert {k for k, x in got.items() if x["verdict"] == "block"} == {1, 4, 6}  # 7, 8, 11, 12 are one component, with an allow
    assert (got[3]["host"], got[3]["path"], got[13]["host"], got[13]["path"]) == ("www.example.net", "/en/1", "", "")


def test_blocks_reach_aliases(spark):
    rows = [(1, "http://a.net/x", ""), (2, "http://b.com/1", '<link rel="canonical" href="http://c.com/2">'), (3, "http://c.com/2#end", ""), (4, "http://d.com/", ""), (5, "http://www.c.com/2/", ""), (6, "https://c.com/2", "")]
    moved = spark.createDataFrame([("http://c.com/2", "http://a.net/x"), (None, "x")], "src string, dst string")
    pages = spark.createDataFrame(rows, PAGES)
    got = {x["page_id"]: x["verdict"] for x in url_filter.judged(pages, redirects=moved).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}  # other ways of writing are no edges
    asked = url_filter.judged(pages, redirects=moved.union(url_filter.writing_edges(pages))).collect()
    assert {x["page_id"] for x in asked if x["verdict"] == "block"} == {1, 2, 3, 5, 6}
    assert url_filter.query(spark.createDataFrame([], PAGES)).count() == 0


NO_LINKS = [
    '<head><!-- <link rel="canonical" href="{u}"> --></head>', "<head><script>'<link rel=canonical href={u}>'</script></head>", '<head></head><body><link rel="canonical" href="{u}">', '<head><template><link rel="canonical" href="{u}"></template>',
    '<body><p><link rel="canonical" href="{u}">', '<head><title><link rel="canonical" href="{u}"></title>', '<head><link rel="noncanonical" href="{u}">', '<head><link title="rel=canonical" href="{u}">', '<head><!-- <link rel="canonical" href="{u}">',
    '<head><meta name="refresh" content="0;url={u}">', '<head><link rel="canonical" data-href="{u}">', '<head><style><link rel="canonical" href="{u}"></style>',
]
LINKS = [
    '<head><link rel="canonical" href="{u}">', "<HEAD><LINK HREF='{u}' REL=Canonical /></HEAD>", '<head><!-- x --><link\nhref={u} rel="alternate canonical"></head>', '<meta http-equiv="Refresh" content="5; URL=\'{u}\'">',
    '<head><script>"</head>"</script><link rel="canonical" href=" {u} ">',
]


def test_links_are_those_of_the_head(spark):
    """Against a parse by hand of each form, and against the SQL."""
    import duckdb

    pages = [(k, f"http://from{k}.com/{k}", t.format(u="http://bad.net/x")) for k, t in enumerate(NO_LINKS + LINKS)]
    df = spark.createDataFrame(pages, PAGES)
    got = {x["page_id"]: x["verdict"] for x in url_filter.query(df).collect()}
    assert got == {k: "allow" if k < len(NO_LINKS) else "block" for k in got}, got
    # more pages, with chains and relative links
    r = random.Random(3)
    hosts = ["a.net", "b.com", "c.org", "example.net", "d.com"]
    for k in range(200):
        target = r.choice([f"http://{r.choice(hosts)}/{r.choice(['en', 'fr', 'de'])}/{r.randint(0, 40)}", f"/en/{r.randint(0, 40)}", f"{r.randint(0, 40)}?q=1&amp;z", f"//{r.choice(hosts)}/fr/{r.randint(0, 40)}"])
        pages.append((100 + k, f"http://{r.choice(hosts)}/{r.choice(['en', 'fr'])}/{r.randint(0, 40)}", r.choice(NO_LINKS + 6 * LINKS).replace("{u}", target)))
    pages += [(900, None, None), (901, "x", link("http://a.net/")), (902, "http://A.net", None)]
    df = spark.createDataFrame(pages, PAGES)
    engine = duckdb.connect()
    engine.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    engine.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    want = engine.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.oracle()})").fetchall()
    assert sorted(tuple(x) for x in url_filter.query(df).select("page_id", "host", "path", "rule", "verdict").collect()) == sorted(want)
    assert {x[4] for x in want if x[3] is None} == {"allow", "block"}


# --- 6 decontamination -----------------------------------------------------------------------------------------------

ITEMS = "item_id bigint, text string"


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, t in items:
        b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        m = min(13, len(b))
        windows = {tuple(b[k : k + m]) for k in range(len(b) - m + 1)} if b else set()
        for k in range(len(w) - m + 1):
            if m and tuple(w[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                found.add(str(item) if item is not None else "")
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_contamination_is_exact(spark, monkeypatch):
    r = random.Random(8)
    items = [(k, " ".join(r.choice("abc") for _ in range(r.choice([1, 2, 5, 13, 14, 30])))) for k in range(1, 25)] + [(30, None), (31, "!!"), (32, "É É"), (None, "b b a")]
    texts = [(k, "".join(r.choice(["a", "b", "c", "A", "é"]) + r.choice([" ", ".", "\n", "--"]) for _ in range(r.randint(0, 120)))) for k in range(60)] + [(100 + k, t) for k, t in enumerate(t for _, t in ODD)]
    bench = spark.createDataFrame(items + items[:3], ITEMS)
    for size, piece in ((1 << 20, 2000), (150, 4)):  # one block of patterns, and many with items in pieces
        monkeypatch.setattr(decontamination, "PIECE_WORDS", piece)
        assert (decontamination.blocks(bench, size)[1] > 1) == (size == 150)
        out = decontamination.contamination(documents(spark, texts), bench, block_bytes=size)
        got = {x["doc_id"]: x["hits"] for x in out.collect()}
        for k, t in texts:
            if len(t or "") < 1000:
                assert (got[k]["n_words"], got[k]["n_hit"], got[k]["n_items"], got[k]["items_sha256"]) == brute_hits(t, items), (size, t)


def test_contamination_edge_cases(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, "no id at all"), (2, prose(random.Random(9), 20))], ITEMS)
    assert decontamination.keep(docs, bench).count() == len(ODD) - 1
    same_columns(decontamination.keep(docs, bench), docs)
    assert decontamination.query(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.query(documents(spark, []), bench).count() == 0


# --- 7 HTML ----------------------------------------------------------------------------------------------------------


def test_extraction_on_held_out_pages():
    model = html_extract.default_model()
    pages = html_extract.labelled_pages(200, seed=1234)
    assert sum(model.extract(h) == t for h, t in pages) >= 190


def test_extraction_details():
    extract = html_extract.default_model().extract
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">More</a></li></ul></nav><div class="ad">Buy now, it is cheap.</div><article><h1>A  title</h1><p>First &amp; &#233;&nbsp;x<br>more<p>Second <b>part</b>.<!-- no --> End.</article><footer>&copy; me</footer>'
    assert extract(page) == "A title\nFirst & é x more\nSecond part. End."
    assert extract(page[: page.index("</article>")] + "</article><div class=comments><p>What a nice text you wrote.</p></div>").endswith("End.")
    for nothing in (None, "", " ", "<!-- x -->", "<script>x</script>", "<", "<a"):
        assert extract(nothing) in ("", "<")
    assert extract("<div>" * 3000 + "x") is not None
    assert extract("just words, without markup.") == "just words, without markup."


def test_extraction_query(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", "<article><p>One two three four.</p></article>"), (None, None, "")], PAGES).withColumn("text", F.lit("mine"))
    got = html_extract.query(pages).collect()
    assert sorted(x["text"] for x in got) == ["", "", "One two three four."] and all(x["n_chars"] == len(x["text"]) for x in got)
    assert html_extract.query(spark.createDataFrame([], PAGES)).count() == 0


# --- 8 quality classifier --------------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    r = random.Random(10)
    junk = [lambda: prose(r, 60).replace(" ", "### "), lambda: (prose(r, 5) + " ") * 15, lambda: prose(r, 60).upper().replace(" ", "!! ")]
    rows = [(k, prose(r, r.randint(40, 90)) if k % 4 else r.choice(junk)()) for k in range(500)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(500)], LABELS)
    docs = documents(spark, rows)
    got = quality_classifier.query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(x["predicted"] == x["quality"] for x in got) >= 0.97 * len(got)
    model = quality_classifier.train(docs, labels)
    assert 0 < len(model.weights) < 60 and any(len(rule) > 1 for rule, _ in model.weights)
    assert model == quality_classifier.train(docs.repartition(3), labels)


def test_compiled_rules_equal_rules(spark):
    """The column against each rule's conditions, evaluated one by one."""
    from math import exp

    r = random.Random(12)
    names = list(quality_classifier.STATISTICS)
    value = lambda: r.choice([0.0, 0.5, 1.0, r.uniform(-2, 2)])
    rules = [(tuple(quality_classifier.Condition(r.choice(names), r.random() < 0.5, value()) for _ in range(r.randint(1, 3))), r.uniform(-2, 2)) for _ in range(30)]
    model = quality_classifier.RuleEnsemble(0.25, tuple(rules))
    rows = [tuple(value() for _ in names) for _ in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = [x["score"] for x in df.select(model.column({n: F.col(n) for n in names}).alias("score")).collect()]
    for row, score in zip(rows, got, strict=True):
        x = dict(zip(names, row, strict=True))
        total = 0.25 + sum(w for rule, w in rules if all((x[c.statistic] > c.threshold) == c.above for c in rule))
        assert abs(score - 1 / (1 + exp(-total))) < 1e-12


def test_classifier_edge_cases(spark):
    docs = odd_docs(spark)
    for labels in (odd_labels(spark), odd_labels(spark).limit(0)):
        got = quality_classifier.query(docs, labels).collect()
        assert len(got) == len(ODD) and all(0 <= x["score"] <= 1 for x in got)
    same_columns(quality_classifier.keep(docs, odd_labels(spark)), docs)
    assert quality_classifier.query(documents(spark, []), odd_labels(spark)).count() == 0


# --- 9 near duplicates -----------------------------------------------------------------------------------------------


def brute_groups(texts, k, num, den):
    sets = []
    for i, t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {(i, len(x), None if i is None else find(i)) for i, x in sets}


def near_corpus(seed, groups=25, extra=30):
    r = random.Random(seed)
    texts = [(1000 + k, prose(r, r.randint(1, 120))) for k in range(extra)]
    for _ in range(groups):
        base = prose(r, r.randint(5, 150)).split()
        for _ in range(r.randint(2, 9)):
            w = base[:]
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = prose(r, 1)
            texts.append((len(texts), " ".join(w).upper() if r.random() < 0.2 else "  ".join(w)))
    return texts


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, monkeypatch, k, num):
    texts = near_corpus(11 + k) + ODD
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 3)  # several blocks within groups
    monkeypatch.setattr(common, "HOT", 4)
    got = near_dedup.near_duplicates(documents(spark, texts).repartition(4), k, num, 100).collect()
    assert {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in got} == brute_groups(texts, k, num, 100)
    assert len(got) == len(texts) and all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


def test_pruning_bound():
    least = near_dedup.least_matches(0.85, 224)
    assert len(least) == 7 and least == sorted(least)
    from math import comb

    n, m = 224, least[-1]
    assert sum(comb(n, x) * 0.85**x * 0.15 ** (n - x) for x in range(m)) < near_dedup.MISS


def test_dedup_keeps_one_of_each(spark):
    docs = odd_docs(spark)
    got = near_dedup.keep(docs)
    same_columns(got, docs)
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in got.collect()) == sorted({(k is None, k or 0) for k, _ in ODD})
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0 and near_dedup.keep(documents(spark, [])).count() == 0


def test_rows_that_repeat_an_id_are_one_node(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(3, words("t")), (5, words("t")), (5, words("u")), (7, words("u")), (7, words("v")), (9, words("v") + " z"), (8, words("x")), (8, words("y"))]
    got = near_dedup.near_duplicates(documents(spark, rows)).collect()
    assert {(x["doc_id"], x["component_id"]) for x in got} == {(i, c) for i, _, c in brute_groups(rows, 5, 80, 100)} == {(3, 3), (5, 3), (7, 3), (9, 3), (8, 8)}
    assert len(got) == len(rows)
    # texts that aren't alike stay, once each
    kept = sorted((x["doc_id"], x["text"]) for x in near_dedup.keep(documents(spark, rows)).collect())
    assert kept == [(3, words("t")), (5, words("u")), (7, words("v")), (8, words("x")), (8, words("y"))]


def test_repeated_row_in_every_partition(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(1, words)] * 400 + [(2, words + " more"), (3, "other words")] + [(None, words)] * 5
    docs = documents(spark, rows).repartition(16)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {(x["doc_id"], x["component_id"]) for x in got} == {(1, 1), (2, 1), (3, 3), (None, None)}
    assert sorted(x["doc_id"] or 0 for x in near_dedup.keep(docs).collect()) == [0] * 5 + [1, 3]


def test_bitmap_of_ids(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("Word")).union(spark.createDataFrame([(None, "y")], "doc_id bigint, Word string"))
    ids = spark.range(0, 3000, 7).select(F.col("id").alias("doc_id"))
    for bits in (64, 1 << 12, 1 << 24):
        monkeypatch.setattr(common, "BITS", bits)
        yes, no = (common.maybe_in(df, "doc_id", ids, w) for w in (True, False))
        assert yes.columns == df.columns
        yes, no = ([r["doc_id"] for r in x.collect()] for x in (yes, no))
        assert set(range(0, 3000, 7)) <= set(yes) and None in no and not set(yes) & set(no) and len(yes) + len(no) == 3001
    assert len(yes) < 450 and common.maybe_in(df, "doc_id", ids.limit(0)).count() == 0


def test_dedup_keeps_unlinked_texts_of_one_id(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(100))
    rows = [(1, words("a")), (1, words("b")), (1, words("a")), (1, words("b") + " more"), (2, words("c")), (2, words("c")), (3, words("c")), (4, words("d"))]
    got = [(x["doc_id"], x["text"].removesuffix(" more")) for x in near_dedup.keep(documents(spark, rows)).collect()]
    assert sorted(got) == [(1, words("a")), (1, words("b")), (2, words("c")), (4, words("d"))]


@pytest.mark.parametrize("unit", ["<div>", "<a ", '<a "x ', '<a x="', "<p>", "<li></li>", "</x>", "<x></p>", "<!--", "<", "<svg>", "&lt"])
def test_pages_take_linear_time(unit):
    """A megabyte of what has no end, alone and below many open elements."""
    import time

    model, n = html_extract.default_model(), (1 << 20) // len(unit)
    for page in (unit * n, "<li><ul>" + "<div>" * 10_000 + unit * n):
        began = time.process_time()
        model.extract(page)
        assert time.process_time() - began < 8  # some seconds at most; quadratic time would be minutes


def test_marginals_equal_enumeration():
    """Sum over all states of small trees."""
    r = random.Random(4)
    model = html_extract.default_model()
    parts = ["<div class=post>", "<p>Some words, a sentence of them.", "</p>", "</div>", "<nav><a href=x>one</a></nav>", "<h1>Title</h1>", "<div class=comment>", "<article>", "</article>"]
    done = 0
    while done < 40:
        page = html_extract.parse("".join(r.choices(parts, k=r.randint(1, 7))))
        n = len(page.tags)
        if not 1 < n <= 6:
            continue
        done += 1
        own = [model.potential(f) for f in html_extract.features(page)]
        (cc, ct, co), (tp, to), (pp, po) = model.from_container, model.from_top, model.from_part
        step = [[cc, ct, 0, co], [0, 0, tp, to], [0, 0, pp, po], [0, 0, 0, 1]]
        total, content = 0.0, [0.0] * n
        for states in itertools.product(range(4), repeat=n):
            w = own[0][states[0]] * (cc, ct, 0, 0)[states[0]]
            for k in range(1, n):
                w *= own[k][states[k]] * step[states[page.parents[k]]][states[k]]
            total += w
            for k in range(n):
                content[k] += w * (states[k] in (1, 2))
        for got, want in zip(model.marginals(page), content, strict=True):
            assert abs(got - want / total) < 1e-9


def test_torn_tags_are_taken_as_browsers_do():
    runs = lambda s: [t for _, t, _ in html_extract.parse(s).runs]
    assert runs("<p>a<b title=\"x>y\">c</b></p><p>d <a href='e") == ["ac", "d"]
    assert runs('<p "x>a</p>1 < 2 <3') == ["a", "1 < 2 <3"]
    assert runs("a<!-- b > c --><!doctype x>d</ e>f<!-->g") == ["adfg"]
    assert runs("a<!-- b") == runs("a<!b") == runs("a<b c") == ["a"]


@pytest.mark.parametrize("tag", ["button", "select", "svg", "math", "object", "canvas", "audio", "video", "template"])
def test_an_unclosed_control_does_not_end_the_page(tag):
    runs = lambda name: [t for _, t, _ in html_extract.parse(f"<article><p>One.</p><{name}><p>Two.</p></article>").runs]
    assert runs(tag) == ["One.", "Two."] and runs("script") == ["One."]


# --- 10 licences -----------------------------------------------------------------------------------------------------


def test_licenses(spark):
    mit, bsd = license_scan.LICENSES["MIT"], license_scan.LICENSES["BSD-3-Clause"]
    rows = [
        (101, mit), (102, "Copyright (c) 2001 Me\n\n(C) You\n" + mit.upper().replace("\n", "\n\n  ").replace("SUBLICENSE", "sub-licence")), (103, mit + " Also this."), (104, mit[:-20]),
        (105, "The MIT License (MIT)\nCopyright 2020 A. Nother\nAll rights reserved.\n\n" + mit), (106, "BSD 3-Clause Licence\n" + bsd.lower()), (107, "see: " + bsd), (108, "Released under the MIT licence"),
    ]
    got = license_scan.query(documents(spark, rows + ODD).withColumn("license", F.lit("mine"))).collect()
    assert len(got) == len(rows) + len(ODD)
    found = {x["doc_id"]: x["license"] for x in got}
    assert found == {101: "MIT", 102: "MIT", 103: None, 104: None, 105: "MIT", 106: "BSD-3-Clause", 107: None, 108: None} | dict.fromkeys(k for k, _ in ODD)
    assert {x["text_sha256"] for x in got} == {license_scan.digest(t or "") for _, t in rows + ODD}
    table = spark.createDataFrame([(license_scan.digest(mit), n) for n in ("b", "a")], "digest string, license string")
    assert license_scan.scanned(documents(spark, rows[:1]), table).first()["license"] == "a"
    assert license_scan.query(documents(spark, [])).count() == 0


def test_spellings_of_neighbours():
    assert license_scan.canonical("Licence, licence LICENCE sub-licence sub license") == "license license license sublicense sublicense"
    assert license_scan.canonical("  (c) 2001\nx ALL RIGHTS\nAll rights reserved. me\ny") == "x all rights y"


def test_whole_long_licenses_are_known():
    import os

    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts on this machine")
    known = license_scan.known()
    for file, name in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0")):
        with open(f"{folder}/{file}", encoding="utf-8") as f:
            text = f.read()
        assert known[license_scan.digest("   " + text.replace(" License ", " LICENCE ").replace("\n", "\r\n"))] == name


def test_licenses_are_native(spark):
    plan = license_scan.query(documents(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- all -------------------------------------------------------------------------------------------------------------


def test_operators_over_mostly_empty_partitions(spark):
    """Far more partitions than rows."""
    r = random.Random(14)
    texts = [(k, prose(r, 70) + (" you idiot" if k % 3 == 0 else "")) for k in range(12)]
    docs = documents(spark, texts).repartition(48)
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(12)], LABELS).repartition(48)
    bench = spark.createDataFrame([(1, texts[4][1])], ITEMS).repartition(48)
    pages = spark.createDataFrame([(k, f"http://a.com/{k}", link("http://a.net/x") + "<body><article><p>Some words here.</p></article>") for k in range(5)], PAGES).repartition(48)
    chats = spark.createDataFrame([(k, t, "user" if t % 2 == 0 else "assistant", "hi") for k in range(4) for t in range(2)], "conv_id bigint, turn int, role string, text string").repartition(48)
    found = {
        "op1": toxicity.query(docs, labels), "op2": quality_rules.query(docs), "op3": chat.query(chats), "op4": sentencepiece_bpe.digests(docs, tokenizer_path()), "op5": url_filter.query(pages),
        "op6": decontamination.query(docs, bench), "op7": html_extract.query(pages), "op8": quality_classifier.query(docs, labels), "op9": near_dedup.query(docs), "op10": license_scan.query(docs),
    }
    counts = {k: len(df.collect()) for k, df in found.items()}
    assert counts == dict.fromkeys(("op1", "op2", "op4", "op6", "op8", "op9", "op10"), 12) | {"op3": 5, "op5": 5, "op7": 5}
    assert found["op6"].where("n_hit > 0").count() == 1

"""The training-data operators on Spark: brute force on small tables, and odd inputs."""

import hashlib
import importlib.util
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from spindrift.llm import decontaminate, language_id, media, oracle, preference, queries, sampling, secrets, simhash, substring_dedup, token_counts, unigram, url_filter
from spindrift.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng, n):
    return " ".join("".join(rng.choices("aeioutnrs", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, near copies, and extra clashing columns."""
    rng = random.Random(0)
    long, base = sentence(rng, 6000), sentence(rng, 300)
    rows = [
        (1, base, "en", "src0", 1),
        (2, base, "en", "src0", 1),
        (3, base + " tail words", None, None, 1),
        (4, None, "en", "src1", None),
        (5, "", "de", "src1", 0),
        (6, long, "en", "src0", 1),
        (6, long, "en", "src0", 1),
        (None, base, "en", "src0", 1),
        (7, "x" * 5000, "en", "src0", 1),
        (8, "▁ \0 é😀\t\n", "fr", "src2", 1),
        (9, sentence(rng, 40) + ' password = "Zx81qLm0Qw77"', "en", "src2", 1),
        (10, " ".join(long.split()[100:160]), "en", "src0", 1),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["id", "fp", "spans", "n_words", "component_id", "fingerprint", "media", "ids", "sample", "words", "row_key", "rule", "verdict"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def rows_by_id(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_media(odd, none):
    wanted = []
    for doc, text in rows_by_id(odd, "doc_id", "text"):
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        wanted.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    got = rows_by_id(media.media_digest(odd), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert got == sorted(wanted, key=repr)
    assert media.media_digest(none).count() == 0


def test_secrets(odd, none):
    got = {r.doc_id: r for r in secrets.secret_digest(odd).collect()}
    assert got[9].n_assign == 1 and "lexed" in got[9].spans and got[4].spans == ""
    assert got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = secrets.redact_column(odd, "text", "n_chars")
    assert clean.columns == odd.columns
    texts = {r.doc_id: r for r in clean.collect()}
    assert "Zx81qLm0Qw77" not in texts[9].text and texts[9].n_chars == len(texts[9].text)
    assert texts[4].text is None and texts[1].n_chars == 1
    assert secrets.secret_digest(none).count() == 0


def test_fingerprint_components(odd, none):
    got = rows_by_id(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id")
    texts = rows_by_id(odd, "doc_id", "text")
    prints = [int(x) for x in simhash.fingerprints([t for _, t in texts]).tolist()]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            root[i] = min([root[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 4])
    wanted = []
    for i, (doc, _) in enumerate(texts):
        ids = [d for j, (d, _) in enumerate(texts) if root[j] == root[i] and d is not None]
        wanted.append((doc, f"{prints[i]:016x}", min(ids, default=None)))
    assert got == sorted(wanted, key=repr)
    assert simhash.near_duplicates(none).count() == 0


def test_hot_buckets_are_split_without_losing_links(spark):
    rng = random.Random(9)
    base, prints = rng.getrandbits(64), set()
    while len(prints) < 300:
        x = base
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
        prints.add(x - (1 << 64) if x >> 63 else x)
    distinct = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    counts = []
    for bucket in (8192, 20):
        edges = simhash.linked_fingerprints(distinct, 4, bucket)
        counts.append(sorted(tuple(r) for r in components(edges, "a", "b").collect()))
    assert counts[0] == counts[1]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_substrings(odd, none):
    def brute(rows, window=20):
        seen, out = set(), []
        for doc, text in rows:
            w = (text or "").split()
            w = re.findall("[^\x20\x09-\x0d]+", text or "")
            gone = set()
            if doc is not None:
                for i in range(len(w) - window + 1):
                    k = tuple(w[i : i + window])
                    if any(at < (doc, i) for at in seen_at.get(k, ())):
                        gone |= set(range(i, i + window))
            out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
        return out

    rows = rows_by_id(odd, "doc_id", "text")
    seen_at = {}
    for doc, text in rows:
        if doc is not None:
            w = re.findall("[^\x20\x09-\x0d]+", text or "")
            for i in range(len(w) - 19):
                seen_at.setdefault(tuple(w[i : i + 20]), []).append((doc, i))
    wanted = sorted(brute(rows), key=repr)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    for options in ({}, {"shard": 3, "heavy": 1}):
        out = substring_dedup.dedup_substrings(odd, **options)
        assert rows_by_id(out, "doc_id", "n_words", removed, F.sha2(F.col("kept").cast("binary"), 256)) == wanted
    assert substring_dedup.dedup_digest(none).count() == 0


def test_token_counts(odd, none):
    got = {r.doc_id: r for r in token_counts.token_counts(odd).collect()}
    counter = token_counts.TrieCounter(unigram.load())
    for doc, text in rows_by_id(odd, "doc_id", "text"):
        if doc is not None:
            assert got[doc].n_tokens == (sum(map(counter.counts(unigram.units(text)).__getitem__, unigram.units(text))) if text else 0)
    assert token_counts.token_counts(none).count() == 0


def test_samples(odd, none):
    out = sampling.encode_samples(odd, k=3, verify=True)
    rows = out.collect()
    assert all(r.exact for r in rows) and {r.doc_id for r in rows} == {None, *range(1, 11)} - {4}
    back = sampling.decode_samples(out.where("doc_id = 8"))
    assert {r.text for r in back.collect()} == {"▁ \0 é😀\t\n"}
    again = sampling.encode_samples(odd.repartition(5), k=3)
    key = lambda r: (repr(r.doc_id), r.sample, r.ids, r.log_prob)
    assert sorted(map(key, rows)) == sorted(map(key, again.collect()))
    assert sampling.encode_samples(none).count() == 0


def test_language(odd, none, spark):
    rng = random.Random(1)
    letters = {"en": "thewandrsoi", "de": "schüöntzgk", "fr": "éèauxqulri"}
    rows = []
    for i in range(240):
        lang = rng.choice(list(letters))
        text = " ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 8))) for _ in range(60))
        rows.append((i, text, lang if i % 4 else rng.choice([lang, lang, None, "en"]), f"h{i % 5}", lang))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, truth string")
    got = language_id.identify(df).join(df.select("doc_id", "truth"), "doc_id")
    assert got.where("language = truth and accepted").count() >= 236
    odd_rows = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert not odd_rows[4].accepted and odd_rows[5].language == "und" and odd_rows[4].posterior == 0.0
    assert language_id.identify(none).count() == 0
    assert language_id.identify(df, declared=None).where("accepted").count() == 0


def test_language_of_texts_without_a_trigram(spark):
    rows = [(i, "the wander of a sound " * 9, "en", "h0") for i in range(30)] + [(i, "schön zug über köln " * 9, "de", "h1") for i in range(30, 60)]
    rows += [(60, "A.", "en", "h0"), (61, "ü", "de", "h1"), (62, "", "en", "h0"), (63, None, "en", "h0")]
    got = {r.doc_id: (r.language, r.accepted) for r in language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert [got[i] for i in range(60, 64)] == [("en", True), ("de", True), ("und", False), ("und", False)]


def test_urls(spark):
    urls = ["http://A.com/x", "http://a.example.com/en/1", "https://www.example.com/en/2?q", "http://x.net/es/3", "http://x.net/de/3", "http://com", "nothing", None, "ftp://u@h:1/p#f", "http://q.net/fr/é"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("rule", F.lit("clash")).withColumn("html", F.lit("x"))
    got = {r.page_id: r for r in url_filter.url_verdicts(df).collect()}
    assert [got[i].rule for i in range(10)] == ["com/", "example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, None, "net/fr/"]
    assert [(got[i].host, got[i].path) for i in (0, 2, 5, 7, 8)] == [("a.com", "/x"), ("www.example.com", "/en/2"), ("com", ""), ("", ""), ("u@h:1", "/p")]
    assert got[1].verdict == "block" and got[2].verdict == "allow" and got[7].verdict == "allow" and got[6].verdict == "allow"
    accepted = [u for i, u in enumerate(urls) if got[i].rule in ("com/", "www.example.com/en/")]
    rejected = [u for i, u in enumerate(urls) if got[i].rule in ("example.com/en/", "net/es/", "net/fr/")]
    order = {r.u: r.h for r in spark.createDataFrame([(u,) for u in accepted + rejected], "u string").withColumn("h", F.xxhash64("u")).collect()}
    ratio = url_filter.fit_ratio(sorted(accepted, key=order.get), sorted(rejected, key=order.get))
    for i in (4, 5, 8):
        assert got[i].score == pytest.approx(ratio.score(urls[i])) and got[i].verdict == ("allow" if got[i].score >= ratio.threshold else "block")
    assert url_filter.url_verdicts(df.limit(0)).count() == 0


def test_all_labelled_urls_are_counted_and_calibrate(spark, monkeypatch):
    rng = random.Random(7)
    good = [f"http://{rng.choice('abc')}{i}.com/{rng.randrange(999)}" for i in range(22_000)] + ["http://long.com/" + "zq" * 3000]
    bad = [f"http://{rng.choice('abd')}{i}.net/fr/{rng.randrange(999)}" for i in range(300)]
    asked = [f"http://{x}{i}.org/{i}" for i, x in enumerate(["zq" * 40, "a", "d", "c.com", "x/fr"])]
    df = spark.createDataFrame(list(enumerate(good + bad + asked + good[:50])), "page_id int, url string")
    order = {r.u: (r.h, r.u) for r in df.select(F.col("url").alias("u"), F.xxhash64("url").alias("h")).distinct().collect()}
    ratio = url_filter.fit_ratio(sorted(good, key=order.get), sorted(bad, key=order.get))
    monkeypatch.setattr(url_filter, "RANGE_ROWS", 500)  # several ranges of scores
    got = {r.url: r for r in url_filter.url_verdicts(df).where("rule is null").collect()}
    assert sorted(got) == sorted(asked)
    for u in asked:
        assert got[u].score == pytest.approx(ratio.score(u), rel=1e-9) and got[u].verdict == ("allow" if got[u].score >= ratio.threshold else "block")
    labelled = url_filter.labelled_urls(df, "url", F.when(F.col("url").contains(".com/"), "allow").when(F.col("url").contains(".net/fr/"), "block"))
    assert url_filter.fit_on(labelled, 4).threshold == pytest.approx(ratio.threshold, rel=1e-9)


def test_contamination(spark, odd, none):
    rng = random.Random(2)
    item, short = sentence(rng, 40), sentence(rng, 3)
    edited = item.split()
    edited[0] = "changed"
    rows = [(1, sentence(rng, 50) + " " + item.upper() + "! " + sentence(rng, 9)), (2, " ".join(edited)), (3, sentence(rng, 80)), (4, None), (5, " ".join(item.split()[:20])), (6, "a " + short + " b"), (None, item), (1, "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("m", F.lit(1))
    bench = spark.createDataFrame([(0, item), (1, short), (2, None), (3, ""), (None, item)], "item_id bigint, text string")
    got = rows_by_id(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "start", "size")
    assert got == sorted([(1, 0, 50, 40), (2, 0, 0, 40), (6, 1, 1, 3), (None, 0, 0, 40)], key=repr)  # a null id is one, too
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0


def test_preferences(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello there"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "?"), (3, 0, "user", "other"), (3, 1, None, None), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", "?"), (1, 0, "user", "hi"), (None, 0, "user", "x"), (5, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("chosen", F.lit("clash"))
    got = {r.chosen_id: r for r in preference.format_preferences(df).collect()}
    assert set(got) == {1, 3}
    pair = got[1]
    assert (pair.rejected_id, pair.prompt, pair.n_copies) == (2, "<|user|>\nhi<|end|>\n", 1)
    assert pair.chosen == "<|assistant|>\nhello there<|end|>\n" and pair.rejected == "<|assistant|>\nyo<|end|>\n<|user|>\n?<|end|>\n"
    for text, mask, said in ((pair.chosen, pair.chosen_mask, ["hello there"]), (pair.rejected, pair.rejected_mask, ["yo"])):
        assert [text[slice(*map(int, x.split("-")))] for x in mask.split(",")] == said
    assert got[3].rejected is None and got[3].rejected_turns is None
    parts = preference.format_preferences(df, part_turns=1).where("chosen_id = 1").orderBy("part").collect()
    assert "".join(p.rejected for p in parts) == pair.rejected and len(parts) == 3
    assert preference.format_preferences(df.limit(0)).count() == 0
    many = spark.createDataFrame([(i, t, "user" if t == 0 else "assistant", "same" if t == 0 else f"r{i}") for i in range(60) for t in (0, 1)], df.drop("chosen").schema)
    assert preference.format_preferences(many).count() == 59
    assert 45 < preference.format_preferences(many, bucket=10).where("rejected_id is not null").count() < 59


def test_preferences_of_a_hot_opening_are_a_chain(spark):
    n = 20_000  # more than one range holds
    talks = spark.range(n).select(F.col("id").alias("conv_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("turn"))
    said = F.concat(F.repeat(F.lit("x"), (F.col("conv_id") % 7).cast("int")), F.lit(" "), F.col("conv_id").cast("string"))
    talks = talks.withColumns({"role": F.when(F.col("turn") == 0, "user").otherwise("assistant"), "text": F.when(F.col("turn") == 0, "same").otherwise(said)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        got = [(r.chosen_id, r.rejected_id) for r in preference.format_preferences(talks).select("chosen_id", "rejected_id").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(range(n), key=lambda i: (-(i % 7 + 1 + len(str(i))), i))
    assert sorted(got) == sorted(zip(order, order[1:], strict=False))


@pytest.mark.parametrize("name", ["op1_preference_format", "op3_decontaminate", "op7_substring_dedup", "secret_base_spans", "url_rules", "media_payloads"])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    wanted = con.sql(queries.oracle_sql()[name])
    columns = sorted(wanted.columns)
    got = rows_by_id(queries.queries()[name](spark, sf_dir), *columns)
    names = wanted.columns
    assert got == sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in wanted.fetchall()), key=repr)
    assert oracle.PREFERENCE


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is optional")
def test_pipeline_stages(spark, odd, sf_dir):
    import corpus_pipeline

    docs = odd
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    assert 4 not in kept[0] and 5 not in kept[0]  # no text, no language
    assert kept[1].count(6) == 1 and sum(x in kept[1] for x in (1, 2)) <= 1
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    decoded = [(r.doc_id, r.text) for r in sampling.decode_samples(out).collect()]
    assert decoded and all(texts[i] == t for i, t in decoded if i is not None)
    assert "Zx81qLm0Qw77" not in " ".join(r.text for r in docs.collect())
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is optional")
def test_pipeline_finds_every_near_copy(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(11)
    texts, line = [], sentence(rng, 12)
    for k in range(12):  # edits that leave a similarity about 0.8, texts that share lines only
        base = sentence(rng, 200 + 10 * k).split()
        texts.append(" ".join(base) + " " + line)
        for edits in range(1, 8):
            copy = list(base)
            for at in rng.sample(range(0, len(copy), 6), edits):
                copy[at] = "edited"
            texts.append(" ".join(copy) + " " + line)
    texts += [sentence(rng, 3), "", line, line.upper(), line]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            root[i] = min(root[j] for j, b in enumerate(sets) if alike(a, b))
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = [r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, sf_dir).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(root))


def posterior_by_hand(rows, names, table, k, worth=60, declared_noise=0.1, suffix_noise=0.3, strength=20.0):
    """The posterior of row ``k`` of (text, declared, host, suffix), by the definition."""
    size = len(names)

    def text_part(text):
        raw = (text or "").lower().encode()
        grams = [raw[i : i + 3] for i in range(len(raw) - 2)]
        bucket = [(((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761) & 0xFFFFFFFF) >> 17 for g in grams]
        return [sum(float(table[n][b]) for b in bucket) * min(1, worth / max(1, len(grams))) for n in range(size)], len(grams)

    heard = []
    for text, _, host, suffix in rows:
        logs, n = text_part(text)
        if n:
            heard.append((host, suffix, max(range(size), key=lambda i: logs[i])))

    def smoothed(some, parent):
        return [(sum(h[2] == i for h in some) + strength * parent[i]) / (len(some) + strength) for i in range(size)]

    root = [(sum(h[2] == i for h in heard) + 1 / size) / (len(heard) + 1) for i in range(size)]
    text, declared, host, suffix = rows[k]
    prior = root
    own = [h for h in heard if h[0] == host and h[1] == suffix]
    if host is not None and own:
        prior = smoothed(own, smoothed([h for h in heard if h[1] == suffix], root) if suffix is not None else root)
    logs = text_part(text)[0]
    for i, name in enumerate(names):
        logs[i] += math.log(prior[i])
        for said, noise in ((declared, declared_noise), (language_id.SUFFIX_LANGUAGE.get(suffix), suffix_noise)):
            if name != "und" and said in names[:-1]:
                logs[i] += math.log(1 - noise) if said == name else math.log(noise / max(1, size - 1))
    best = max(range(size), key=lambda i: logs[i])
    return names[best], 1 / sum(math.exp(x - logs[best]) for x in logs)


def test_language_posteriors_by_hand(spark):
    rng = random.Random(3)
    letters = {"en": "theoans", "de": "ichungsz", "fr": "eausoil"}
    rows = []
    for i in range(90):
        name = rng.choice(sorted(letters))
        text = " ".join("".join(rng.choices(letters[name], k=5)) for _ in range(rng.choice([1, 2, 8])))
        tag = rng.choice([name, name.upper(), f"{name}-XX", None, "en", "x-klingon", ""])
        rows.append((i, text, tag, rng.choice(["a.x", "b.x", "c.x", None]), rng.choice(["de", "fr", "org", None])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, tld string")
    got = {r.doc_id: r for r in language_id.identify(df, suffix=F.col("tld")).collect()}
    plain = lambda tag: (m[1] if (m := re.match("([a-z]{2,3})(?:[-_].*)?$", (tag or "").lower())) else None)
    names, table = language_id.fit(df.withColumn("lang", language_id.primary_subtag(F.col("lang"))), "doc_id", "text", "lang")
    assert names == ["de", "en", "fr", "und"]
    given = [(r[1], plain(r[2]), r[3], r[4]) for r in rows]
    for i in range(len(rows)):
        name, posterior = posterior_by_hand(given, names, table, i)
        assert got[i].language == name and got[i].posterior == pytest.approx(posterior, abs=2e-5)


def test_every_declared_language_can_win(spark):
    rng = random.Random(8)
    tags = [a + b for a in "abcdefg" for b in "hijklm"]  # 42 languages of their own words
    rows = []
    for i, tag in enumerate(tags * 3):
        seeded = random.Random(tag)
        words = ["".join(seeded.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(6)]
        rows.append((i, " ".join(rng.choices(words, k=30)), tag, None, 0))
    out = language_id.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.language for r in out} == set(tags)
    assert sum(r.language == rows[r.doc_id][2] for r in out) >= 0.95 * len(rows)


def test_language_of_pages_uses_markup_and_address(spark, sf_dir):
    rows = [("https://Shop.Example.DE:8080/x?y=1", '<!doctype html><HTML class="a" LANG="de-AT"><p>hi</p>'), ("no address", "<html lang=''>"), (None, None), ("ftp://host/", "<html lang=fr>")]
    df = spark.createDataFrame(rows, "url string, html string")
    got = [tuple(r) for r in df.select(language_id.declared_in(F.col("html")), language_id.suffix_in(F.col("url")), language_id.host_in(F.col("url"))).collect()]
    assert got == [("de", "de", "shop.example.de"), (None, None, None), (None, None, None), ("fr", "host", "host")]
    out = queries.language_of_pages(spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert sorted(r.page_id for r in out.collect()) == sorted(r.page_id for r in pages.collect())
    same = out.join(pages.select("page_id", language_id.declared_in(F.col("html")).alias("said")), "page_id").where("said is not null")
    assert same.where("language = said").count() >= 0.8 * same.count()


def test_substrings_of_odd_words_and_repeated_ids(spark, monkeypatch):
    same = " ".join(f"w{i}" for i in range(19))
    odd_word = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    texts = [(1, f"{odd_word} {same}"), (2, f"{odd_word.translate(str.maketrans('ab', 'ba'))} {same}")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_digest(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0}
    rng = random.Random(2)
    a, b = sentence(rng, 61), sentence(rng, 61)
    rows = spark.createDataFrame([(7, a), (7, b), (3, a)], "doc_id bigint, text string")
    assert rows_by_id(substring_dedup.dedup_digest(rows), "doc_id", "n_words", "n_removed") == [(3, 61, 0), (7, 61, 0), (7, 61, 61)]
    # places are told apart in chunks, however long a text is
    long = [" ".join(rng.choices("abcdefgh", k=400)).encode() for _ in range(3)]
    whole = substring_dedup.segments(long)
    monkeypatch.setattr(substring_dedup, "CHUNK", 50)
    cut = substring_dedup.segments(long)
    owner = lambda seg: {(t, i): h for t, s, n, h in zip(seg["text"], seg["start"], seg["n"], seg["h"], strict=True) for i in range(s, s + n)}
    assert owner(whole) == owner(cut)


def test_a_passage_in_every_text_is_removed_but_once(spark):
    rng = random.Random(4)
    passage = sentence(rng, 25)
    texts = [(i, f"{sentence(rng, 3000)} before{i} {passage} after{i} {sentence(rng, 5)}") for i in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(2)
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_digest(df).collect()}
    first = min(i for i, _ in texts)
    assert got == {i: 0 if i == first else 25 for i, _ in texts}


def test_contamination_of_rows_without_ids(spark):
    rng = random.Random(6)
    item, other = sentence(rng, 30), sentence(rng, 30)
    docs = spark.createDataFrame([(None, sentence(rng, 9) + " " + item), (None, sentence(rng, 40)), (5, other + " " + item), (5, sentence(rng, 8))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, other), (None, item)], "item_id bigint, text string")
    got = rows_by_id(decontaminate.contaminated(docs, items), "doc_id", "item_id", "start", "similarity")
    assert got == sorted([(None, 1, 9, 1.0), (5, 1, 30, 1.0), (5, 2, 0, 1.0)], key=repr)


def test_the_radius_finds_what_the_similarity_asks_for(spark):
    """Windows of similarity 0.8 to 0.85, by chance edits: all but one in a thousand within it."""
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        base = [rng.getrandbits(63) for _ in range(rng.randint(20, 80))]
        gone = int(len(base) / 9)  # (n - g) / (n + g) is 0.8
        rows.append((i, base, base[gone:] + [rng.getrandbits(63) for _ in range(gone)]))
    df = spark.createDataFrame(rows, "i bigint, a array<bigint>, b array<bigint>")
    prints = [decontaminate._simhash(df.select("i", F.explode(c).alias("s")), ["i"]).select("i", F.col("fp").alias(c + "f")) for c in "ab"]
    far = prints[0].join(prints[1], "i").where(F.bit_count(F.col("af").bitwiseXOR(F.col("bf"))) > decontaminate.RADIUS).count()
    assert far <= 1500 * 0.002


def test_a_hub_is_joined_by_broadcast(spark, monkeypatch):
    from spindrift.llm import components as module

    monkeypatch.setattr(module, "HEAVY", 5)
    edges = spark.createDataFrame([(1, i) for i in range(2, 60)] + [(100, 59), (100, 101), (200, 201)], "a bigint, b bigint")
    got = dict(rows_by_id(components(edges, "a", "b"), "node", "root"))
    assert got == {**{i: 1 for i in [*range(1, 60), 100, 101]}, 200: 200, 201: 200}

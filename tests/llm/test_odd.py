"""Names that clash, hosts and ids that are null, repeated ids, long chains, and whole queries against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("bytequarry.llm")
from bytequarry.llm import bpe, common, decontaminate, fingerprint, lines, neardup, pii, quality, secrets, tokenfile, toxicity  # noqa: E402

NAMES = ["_other", "_found", "exceptions", "text_mark", "_gone", "gone", "boiler", "_kept", "kept_lines", "_host", "host_key", "is_cut", "_cut", "leaked_id", "mark", "ord", "part", "key", "a", "b", "size", "at"]


@pytest.fixture(scope="module")
def clash(spark):
    rows = [(k, f"menu\nMrs Anna Smith wrote page {k} to ann{k}@example.com", "en", "s", 9, *range(len(NAMES))) for k in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES))


def test_any_column_names(spark, clash):
    bench = spark.createDataFrame([(1, "Mrs Anna Smith wrote page 3 to")], "item_id long, text string")
    for made in (neardup.keep_one(clash), decontaminate.clean(clash, bench), toxicity.keep_clean(clash, toxicity.fit([], {0: 9, 1: 1})), lines.drop_boilerplate(clash, F.col("source")), pii.pseudonymize(clash, "k")):
        rows = made.collect()
        kept = [c for c in clash.columns if c in made.columns and c != "_found"]
        assert kept == [c for c in clash.columns if c != "_found" or c in kept]
        for r in rows:
            assert all(r[n] == k for k, n in enumerate(NAMES) if n != "_found")
    for made in (neardup.groups(clash), bpe.encode_digests(clash), fingerprint.edit_digests(clash), secrets.secret_digests(clash)):
        assert made.count() == 6


def test_null_hosts_are_no_empty_hosts(spark):
    rows = [(1, "menu\none", None), (2, "menu\ntwo", None), (3, "menu\nthree", ""), (4, "menu\nfour", "")]
    got = lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source"), ratio=0.5).collect()
    assert not any(r._n_dropped for r in got)
    rows.append((5, "menu\nfive", None))
    got = {r.doc_id: r._n_dropped for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source"), ratio=0.5, most_loss=None).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 3: 0, 4: 0}


def test_rows_without_id_are_held_out(spark, clash):
    none = spark.createDataFrame([(None, "x")], "doc_id long, text string")
    assert toxicity.score(none, toxicity.fit([], {})).head().held_out is True
    assert spark.range(1).select(common.held_out(F.lit(7))).head()[0] == (zlib.crc32(b"7") % 5 == 0)


def test_conflicting_labels_teach_nothing(spark, tmp_path):
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    spark.createDataFrame([(k, f"text {k} b") for k in ids] + [(ids[0], "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in ids] + [(ids[1], 1 - ids[1] % 2)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sample, counts = common.labelled_sample(spark, str(tmp_path), "toxic", 1_000)
    rows = {r.doc_id: r.text for r in sample.collect()}
    assert rows.keys() == set(ids) - {ids[1]} and sum(counts.values()) == len(ids) - 1 and rows[ids[0]] == "a"
    few, _ = common.labelled_sample(spark, str(tmp_path), "toxic", 10)
    assert few.count() == 10


def test_a_shared_id_spans_parts():
    limits = np.array([1, 5, 5, 5, 9])
    ord = np.array([0, 1, 3, *[5] * 6, 7, 9])
    mark = np.array([0, 0, 0, *(np.linspace(-1, 0.99, 6) * 2**63), 0, 0]).astype(np.int64)
    part = fingerprint.parts_of(limits, ord, mark)
    assert (np.diff(part) >= 0).all() and len(set(part[3:9])) == 3


def test_long_texts_by_paragraphs(monkeypatch):
    rng = random.Random(3)
    text = "\n".join(" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 30))) for _ in range(60))
    want = fingerprint.fingerprints([text])
    monkeypatch.setattr(fingerprint, "PIECE", 200)
    got = fingerprint.fingerprints([text])
    assert all((a == b).all() for a, b in zip(want, got, strict=True))


def test_long_chains_settle(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    with common.Scratch(spark) as scratch:
        assert {r.root for r in neardup.components(links, scratch).collect()} == {0}
    with common.Scratch(spark) as scratch, pytest.raises(RuntimeError):
        neardup.components(links, scratch, rounds=2)


def test_tiles_meet_once(spark):
    left = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 7), (2, 8)], "key long, id long")
    cells = neardup.tiled(left, 10)
    x, y = (cells.select("key", "t", "u", F.col("id").alias(f"{s}_id"), F.col("side").alias(f"{s}_side")) for s in "ab")
    once = F.when(F.col("t") == F.col("u"), F.col("a_id") < F.col("b_id")).otherwise(F.col("a_side") < F.col("b_side"))
    got = sorted((r.key, *sorted((r.a_id, r.b_id))) for r in x.join(y, ["key", "t", "u"]).where(once).collect())
    assert got == sorted([(1, i, j) for i in range(50) for j in range(i + 1, 50)] + [(2, 7, 8)])


def test_queries_equal_brute_force(spark, small):
    """Token ids, BPE, fingerprints and secrets over the whole small table, column by column."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    t = pq.read_table(f"{small}/documents.parquet").to_pydict()
    docs = {i: x or "" for i, x in zip(t["doc_id"], t["text"], strict=True)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    byte, word = Tokenizer.from_file(tokenfile.default_path()), Tokenizer.from_file(bpe.default_path())
    at, want = 0, {}
    for i in sorted(docs):
        ids = byte.encode(docs[i], add_special_tokens=False).ids + [0]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.op4_token_ids(spark, small).collect()} == want
    want = {}
    for i, x in docs.items():
        ids = word.encode(x, add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2_bpe(spark, small).collect()} == want
    order = sorted(docs, reverse=True)
    for r in fingerprint.op6_fingerprint(spark, small).collect():
        x, y = docs[r.doc_id], docs[order[(order.index(r.doc_id) + 1) % len(order)]]
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        own, new, nxt = (fingerprint.fingerprints([z]) for z in (x, edited, y))
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(x), sha(edited), fingerprint.pack(*own)[0], fingerprint.pack(*new)[0])
        assert (r.near_edited, r.near_next) == pytest.approx((fingerprint.likeness(own, new)[0], fingerprint.likeness(own, nxt)[0]))
    for r in secrets.op10_secrets(spark, small).collect():
        found = []
        for k, rule in enumerate(secrets.BASE):
            found.append([(m.start(), k, m.end()) for m in rule.compiled().finditer(docs[r.doc_id]) if m.end(rule.group) - m.start(rule.group) >= rule.shortest])
        spans = sorted(s for f in found for s in f)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, found))
        assert r.base_sha256 == sha(",".join(f"{secrets.BASE[k].kind}:{s}:{e}" for s, k, e in spans))


def tokens_of(text):
    """The template tokens and slots of a text, as the docstring of decontaminate tells, in Python."""
    import regex

    marked = regex.sub(r"(?<=[\p{Ll},;] )(?=\p{Lu}\p{Ll})", "\x01", text)
    raw = regex.findall(r"\x01?[\p{L}\p{M}]+|\p{N}+(?:[.,]\p{N}+)*", marked)
    kinds = []
    for k, t in enumerate(raw):
        number = lambda x: "0" <= x[0] <= "9"
        kinds.append("name" if t[0] == "\x01" else "num" if number(t) else "unit" if k and number(raw[k - 1]) and t.lower() in decontaminate.UNITS else t.lower())
    return raw, kinds


def test_leaks_equal_all_pairs(spark, small):
    """Every document against every item: a shift at which 60 % of the item's places lie in equal windows, or 25 places."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: r.text or "" for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    split = {i: tokens_of(x)[1] for i, x in items.items()}
    want = set()
    for d, x in docs.items():
        ours = tokens_of(x)[1]
        place = {}
        for k in range(len(ours) - 7):
            place.setdefault(tuple(ours[k : k + 8]), []).append(k)
        for kinds in split.values():
            cover = {}
            for k in range(len(kinds) - 7):
                for p in place.get(tuple(kinds[k : k + 8]), ()):
                    cover.setdefault(p - k, set()).update(range(k, k + 8))
            if any(len(c) >= 0.6 * len(kinds) or len(c) >= 25 for c in cover.values()):
                want.add(d)
    got = {r.doc_id for r in decontaminate.leaked_ids(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert want and want <= got and len(got - want) <= len(got) // 10


def test_first_and_last_words_are_no_leak(spark):
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    other = words[:9] + [f"other{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(42)] + words[-9:]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "Yes")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(other)), (2, "He said yes to all of it"), (3, " ".join(words)), (4, "yes"), (None, " ".join(words))], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.leaked_ids(docs, bench).collect()} == {3, 4}
    assert sorted(r.doc_id or 0 for r in decontaminate.clean(docs, bench).collect()) == [0, 1, 2]


def test_slots_are_one_to_one(spark):
    item = "Near the old bridge 12 ducks met 14 geese, and later 12 ducks flew far over the wide lake with 14 geese behind them"
    rows = [item.replace("12", "5").replace("14", "6"), item.replace("12", "5").replace("14", "5")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.slots for r in decontaminate.leaks(docs, bench).collect()}
    assert got.get(0) == 2 and 0 in got


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All stages on a small table with every odd case, against plain Python."""
    import corpus_pipeline as p

    rng = random.Random(9)
    vocabulary = [f"{a}{b}n" for a in "bcdfgklmprst" for b in ("a", "e", "i", "o", "ou", "ai")]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(k, f"menu of the site\n{prose(60)}\nline {k} {prose(5)}", "en", "h1", 0) for k in range(12)]
    near = rows[0][1].split(" ")
    near[30] = "changed"
    item = prose(30)
    rows += [(20, rows[0][1], "en", "h1", 0), (21, " ".join(near), "en", "h2", 0), (22, f"{prose(20)} {item} {prose(20)}", "en", "h2", 0), (23, None, None, None, None), (24, "", "en", "h2", 0), (None, prose(40), "en", None, 0), (25, "idiot scum idiot scum you vile scum", "en", "h2", 0), (26, prose(30), "en", "h2", 0), (26, prose(30), "en", "h2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    taught = [(k, prose(30) + (" vile scum idiot" if k % 2 else "")) for k in range(100, 300)]
    spark.createDataFrame(rows + [(k, x, "en", "h3", 0) for k, x in taught], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k, _ in taught], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = p.toxicity_stage(spark, docs, folder).collect()
    ids = {r.doc_id for r in clean}
    assert 25 not in ids and {r[0] for r in rows} - {25} <= ids and not any(k % 2 for k in ids if k and k >= 100)
    kept = spark.createDataFrame(rows, schema)
    pages, found = {}, {}
    for _, x, _, host, _ in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in {y.strip(" ") for y in (x or "").split("\n")} - {""}:
            found[host, line] = found.get((host, line), 0) + 1
    drop = {k for k, n in found.items() if n >= 3 and n > 0.02 * pages[k[0]]}
    lined = [(i, None if x is None else "\n".join(y for y in x.split("\n") if (h, y.strip(" ")) not in drop)) for i, x, _, h, _ in rows]
    got = p.line_stage(spark, kept, folder).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got) == sorted((i if i is not None else -1, x or "") for i, x in lined)
    sets = {}
    for i, x in lined:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower())
        if i is not None and w:
            sets.setdefault(i, []).append(frozenset(zip(*[w[j:] for j in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)]))
    gone = {j for i in sets for j in sets if i < j and any(5 * len(a & b) >= 4 * len(a | b) for a in sets[i] for b in sets[j])}
    docs3 = spark.createDataFrame([(i, x, "en", "h", 0) for i, x in lined], schema)
    got = sorted(r.doc_id if r.doc_id is not None else -1 for r in p.near_stage(spark, docs3, folder).collect())
    assert gone >= {20} and got == sorted(i if i is not None else -1 for i, _ in lined if i not in gone)
    leaked = {r.doc_id for r in p.leak_stage(spark, docs3, folder).collect()}
    assert leaked == {i for i, _ in lined} - {22}
    out = p.token_stage(spark, docs3, folder)
    assert out.count() == len(lined)
    none = kept.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, folder).count() == 0

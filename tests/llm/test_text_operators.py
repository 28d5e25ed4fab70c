"""Small cases and brute-force versions of the text operators."""

import hashlib
import html
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from ledgerlens.llm import bpe, chat, decontaminate, licenses, pages, quality, simhash, substring, toxicity, warc
from ledgerlens.llm.common import join_hot_aware, join_salted, shared_dir
from ledgerlens.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _rank int, _spans int, rejected_by string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "no") for i, t in texts], DOCS)


def prose(rng, n, letters="abcdefg"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


# Joins


def test_hot_keys_are_spread_and_joined(spark):
    rows = [(k, "hot" if k % 2 else None if k % 10 == 0 else f"k{k % 40}") for k in range(4000)]
    left = spark.createDataFrame(rows, "i long, key string").repartition(3)
    right = left.where("key is not null").groupBy("key").count().withColumnRenamed("count", "n").selectExpr("key", "n", "concat(key, '!') as said").where("key <> 'k2'")
    for how in ("inner", "left"):
        got = {r["i"]: r["said"] for r in join_hot_aware(left, right, "key", "n", len(rows), how).collect()}
        want = {i: f"{k}!" if k not in (None, "k2") else None for i, k in rows}
        assert got == {i: v for i, v in want.items() if v is not None or how == "left"}
        sizes = right.select("key", "n")
        got = {r["i"]: r["said"] for r in join_salted(left, right.drop("n"), "key", sizes, len(rows), how=how).collect()}
        assert got == {i: v for i, v in want.items() if v is not None or how == "left"}


# Long texts, null ids, repeated rows


def test_long_texts_null_ids_and_repeated_rows(spark):
    rng = random.Random(53)
    long = prose(rng, 120_000, "abcdefghij")
    part = long.split()[60_000:60_100]
    twice = f"{prose(rng, 30)} {' '.join(part)} {prose(rng, 30)}"
    item = " ".join(long.split()[100_000:100_020])
    notice = "Licensed under CC BY 4.0"
    rows = [(1, long), (2, twice), (2, twice), (None, item), (None, item), (3, f"{long}\n{notice}"), (4, notice), (4, notice)]
    df = documents(spark, rows)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.report(df, bench).collect())
    assert found == sorted((i or 0, *slow_contamination(t, [(7, item)])[:2], slow_contamination(t, [(7, item)])[4]) for i, t in rows)
    metrics = sorted((r["doc_id"] or 0, r["n_words"], r["n_repeat_words"]) for r in quality.metrics(df, list(quality.RULES)).collect())
    assert metrics == sorted((i or 0, slow_metrics(t)[0], slow_metrics(t)[4]) for i, t in rows)
    prints = sorted((r["doc_id"] or 0, r["fingerprint"]) for r in simhash.near_duplicates(df).collect())
    assert prints == sorted((i or 0, f"{slow_fingerprint(t):016x}") for i, t in rows)
    spans = {(r["doc_id"], r["source_doc_id"]): r for r in substring.passages(df).collect()}
    assert set(spans) == {(2, 1), (3, 1)} and spans[3, 1]["matched_words"] == 120_000 and spans[2, 1]["source_start"] == 60_000
    path = vocabulary("word_bpe_49k.json")
    coded = [(r["doc_id"], list(r["ids"])) for r in bpe.encode(df, path).collect()]
    assert len(coded) == len(rows) and [i for i, _ in coded].count(None) == 2 and all(a == b for i, a in coded for j, b in coded if i == j)
    files = df.selectExpr("doc_id as id", "concat('/', coalesce(doc_id, 0)) as path", "text")
    licences = sorted((r["id"] or 0, r["licence"]) for r in licenses.scan(files).collect())
    assert licences == [(0, None), (0, None), (1, None), (2, None), (2, None), (3, "CC-BY-4.0"), (4, "CC-BY-4.0"), (4, "CC-BY-4.0")]
    archive = f"{shared_dir(spark)}/archive-test-{random.random()}"
    warc.write_archive(df.selectExpr("doc_id as page_id", "'u' as url", "text as html"), archive)
    kept = [(r["page_id"], r["payload_bytes"]) for r in warc.read_archive(spark, archive).collect()]
    assert sorted((i or 0, n) for i, n in kept) == sorted((i or 0, len(t.encode())) for i, t in rows)


def test_equal_cosines_go_to_the_smaller_licence(spark):
    both = "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC"
    filler = [(k, f"/f/{k}.txt", "words of no licence at all", 0) for k in range(10, 20)]
    df = spark.createDataFrame([(1, "/a.c", both, 0), *filler], "id long, path string, text string, licence int")
    assert licenses.own_licences(df).where("id = 1").first()["licence"] == "ISC"


# Simhash


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash.FOLD))
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(lambda: 10**9)
    for i, (doc, _) in enumerate(prints):
        least[find(i)] = min(least[find(i)], doc)
    return {doc: least[find(i)] for i, (doc, _) in enumerate(prints)}


def near_texts():
    rng = random.Random(3)
    base = [prose(rng, 300) for _ in range(12)]
    texts = []
    for k in range(150):
        words = base[k % 12].split()
        for _ in range(k % 5):
            words[rng.randrange(len(words))] = "zz"
        texts.append((k, " ".join(words)))
    return texts + [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE two"), (205, base[0])]


def test_simhash_against_all_pairs(spark):
    texts = near_texts()
    found = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [(i, slow_fingerprint(t)) for i, t in texts]
    assert {i: found[i]["fingerprint"] for i, _ in prints} == {i: f"{p:016x}" for i, p in prints}
    assert {i: r["component_id"] for i, r in found.items()} == slow_components(prints)
    assert found[200]["component_id"] == found[202]["component_id"] == 200


def test_keep_one_keeps_one_of_each_component(spark):
    texts = near_texts() + [(0, near_texts()[0][1])]
    kept = simhash.keep_one(documents(spark, texts))
    assert kept.columns == documents(spark, []).columns
    expected = sorted(set(slow_components([(i, slow_fingerprint(t)) for i, t in near_texts()]).values()))
    assert sorted(r["doc_id"] for r in kept.collect()) == expected
    assert simhash.keep_one(documents(spark, [])).count() == 0


def test_keep_one_keeps_different_texts_of_one_id(spark):
    rng = random.Random(23)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(None, a), (None, b), (None, a), (5, c), (5, d), (5, c), (9, d)]
    kept = simhash.keep_one(documents(spark, rows)).select("doc_id", "text").collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == sorted([(-1, a), (-1, b), (5, c), (5, d)])


# Quality


def slow_metrics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


QUALITY = [
    (1, None), (2, ""), (3, "a\x0bb\x0cc\rd"), (4, "w " * 50), (5, "é ü # % a\n\na\na b\n"), (6, prose(random.Random(1), 200)), (7, "a b c d e f a b c d e x y z a b c d e"),
    (8, "SHOUT " * 3 + "A B C D E F G HELLO WORLD AGAIN"), (6, prose(random.Random(1), 200)), (None, "x"),
]


def test_quality_metrics_and_verdict(spark):
    docs = documents(spark, QUALITY)
    rules = quality.order_rules(docs)
    assert {r.name for r in rules} == {r.name for r in quality.RULES}
    rows = quality.metrics(docs, rules).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == sorted(
        (str(i), *slow_metrics(t)) for i, t in QUALITY
    )
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_the_order_of_rules_never_changes_the_verdict(spark):
    docs = documents(spark, QUALITY)
    forward = quality.cascade(docs, list(quality.RULES)).where("rejected_by is null").select("doc_id")
    backward = quality.cascade(docs, list(quality.RULES)[::-1]).where("rejected_by is null").select("doc_id")
    judged = quality.metrics(docs, list(quality.RULES)).where("kept").select("doc_id")
    assert sorted(forward.collect()) == sorted(backward.collect()) == sorted(judged.collect())


CLASHES = "doc_id long, text string, _q_n_words long, _Q_TEXT string, n_words int, _0 string, `a.b` string, Rejected_By string, _SPANS int"


def test_columns_of_any_name_are_safe(spark):
    text = " ".join(f"word{k} and" for k in range(9))
    df = spark.createDataFrame([(1, text, 0, "x", 3, "y", "z", "no", 7), (2, None, None, None, None, None, None, None, None)], CLASHES)
    rows = {r["doc_id"]: r for r in quality.metrics(df, list(quality.RULES)).collect()}
    assert (rows[1]["n_words"], rows[1]["base_failed"], rows[1]["kept"]) == (18, False, True)
    judged = quality.cascade(df, quality.order_rules(df))
    assert [c for c in judged.columns if c.lower() != "rejected_by"] == [c for c in df.columns if c != "Rejected_By"]
    assert {r["doc_id"]: r["rejected_by"] for r in judged.collect()} == {1: None, 2: "few_words"}
    empty = df.limit(0)
    assert quality.metrics(empty, quality.order_rules(empty)).count() == 0
    assert substring.cut(df).columns == df.columns and substring.cut(df).count() == 2
    assert simhash.keep_one(df.union(df)).columns == df.columns and simhash.keep_one(df.union(df)).count() == 2
    bench = spark.createDataFrame([(1, "word0 and word1"), (None, None)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.clean(df, bench).collect()] == [2]


def test_equal_rules_keep_their_order(spark):
    empty = documents(spark, [])
    assert quality.order_rules(empty) == list(quality.RULES)


# Decontamination


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_contamination(text, items):
    words, hit, names = slow_words(text), set(), set()
    for name, item in items:
        w = slow_words(item)
        for window in {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w and name is not None else ():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("broadcast_bytes", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination_against_scanning(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast_bytes)
    rng = random.Random(5)
    items = [(i, prose(rng, 30, "abc")) for i in range(6)] + [(6, "Short ITEM here"), (7, None), (8, "..."), (9, "É É"), (None, "no id at all")]
    texts = [(i, prose(rng, 60, "abc")) for i in range(10)]
    texts += [(10, f"x {items[0][1].upper()} y"), (11, items[1][1][20:]), (12, "a short, item HERE b"), (13, None), (14, ""), (15, items[2][1] + " " + items[3][1]), (15, "other"), (16, "É É É")]
    texts += [(17, items[4][1] + " " + prose(rng, 900, "xyz"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.report(documents(spark, texts), bench).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows)
    assert got == sorted((i, *slow_contamination(t, items)) for i, t in texts)
    clean = decontaminate.clean(documents(spark, texts), bench)
    assert sorted((r["doc_id"], r["text"] or "") for r in clean.collect()) == sorted((i, t or "") for i, t in texts if not slow_contamination(t, items)[4])
    assert decontaminate.report(documents(spark, texts), bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.report(documents(spark, []), bench).count() == 0


# BPE


def test_bpe_is_the_librarys(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = ["", None, "The cat's  ÉCOLE ÑANDÚ 12½ !!! <|endoftext|>it's ΟΔΟΣ", "<|endoftext", "a\x1cb c\u0085d​e", "x" * 5000, "é" * 300, "<|startoftext|><|endoftext|>"]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0x24F), rng.randint(0x250, 0x3000), 0x1F600])) for _ in range(60)) for _ in range(300)]
    texts += [prose(rng, 50, "abcdehlorst") for _ in range(100)]
    coded = bpe.decode(bpe.encode(documents(spark, enumerate(texts)), path), path)
    for r in coded.collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    both = bpe.there_and_back(documents(spark, enumerate(texts)), path)
    assert sorted(map(tuple, both.collect()), key=lambda r: r[0]) == sorted(map(tuple, coded.collect()), key=lambda r: r[0])
    assert bpe.encode(documents(spark, []), path).count() == bpe.there_and_back(documents(spark, []), path).count() == 0


def test_proposals_that_fail_are_merged():
    encoder = bpe.Encoder(open(vocabulary("word_bpe_49k.json"), encoding="utf-8").read())
    rng = random.Random(4)
    words = ["".join(rng.choice("abdehilnorst") for _ in range(rng.randint(4, 16))) for _ in range(3000)]
    proposed = [encoder.propose(w) for w in words]
    offsets, ids = encoder.encode(words)
    final = [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(len(words))]
    assert final == [encoder.merge(w) for w in words]
    assert any(a != b for a, b in zip(proposed, final, strict=True))


def test_words_that_come_again_are_remembered(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    encoder = bpe.Encoder(open(vocabulary("word_bpe_49k.json"), encoding="utf-8").read())
    rng = random.Random(6)
    common = ["".join(rng.choice("abdehilnorst") for _ in range(9)) for _ in range(12)]
    learned, learn = [], encoder.learn
    encoder.learn = lambda words: (learned.extend(words), learn(words))
    for _ in range(30):
        text = " ".join([*common, *("".join(rng.choice("abdehilnorst") for _ in range(11)) for _ in range(8)), "<|endoftext|>", "x" * 40])
        assert encoder.encode([text])[1].tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    assert all(learned.count(w) == 1 for w in common) and len(encoder.index) <= 60


def test_short_and_long_merges_agree(monkeypatch):
    encoder = bpe.Encoder(open(vocabulary("word_bpe_49k.json"), encoding="utf-8").read())
    rng = random.Random(5)
    words = ["".join(rng.choice("aehnst") for _ in range(rng.randint(1, 24))) for _ in range(2000)]
    short = [encoder.merge(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert short == [encoder.merge(w) for w in words]


# Chat


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


CHATS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (2, 0, "user", "hello"), (2, 1, "assistant", "hi"), (2, 2, "user", "more"), (3, 0, "user", "hello"), (3, 1, "assistant", "ho"),
    (4, 0, "system", "<|im_end|>\n<|im_start|>assistant\nx \\ <\\| é"), (4, 1, "assistant", "<|im_end|> \\n <|endoftext|>"), (5, 0, None, None), (6, 0, "a\nb", ""), (7, 0, "user", "hello"), (7, 1, "assistant", "hi"),
    (8, 1, "assistant", "second"), (8, 0, "assistant", "first"), (8, 1, "assistant", "also second"),
]


def test_chats_come_back_as_they_were(spark):
    path = vocabulary("byte_bpe_50k.json")
    nodes, members = chat.build(conversations(spark, CHATS), path)
    got = {r["conv_id"]: r for r in chat.digests(nodes, members, path).collect()}
    by_id = defaultdict(list)
    for c in CHATS:
        by_id[c[0]].append((c[1], c[2] or "", c[3] or ""))
    assert set(got) == set(by_id)
    for k, turns in by_id.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[k]["formatted_chars"] == sum(len("".join(chat.frame(r, t))) for _, r, t in turns)


def test_the_forest_is_depth_first_and_attends_to_ancestors(spark):
    nodes, _ = chat.build(conversations(spark, CHATS), vocabulary("byte_bpe_50k.json"))
    rows = sorted(nodes.collect(), key=lambda r: r["start"])
    named = {bytes(r["node"]): r for r in rows}
    assert sum(r["depth"] == 0 and r["n_refs"] == 4 for r in rows) == 1
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["token_ids"])
        above, position = r["parent"], 0
        ancestors = set()
        while above is not None:
            ancestors.add(bytes(above))
            position += len(named[bytes(above)]["token_ids"])
            above = named[bytes(above)]["parent"]
        assert r["position"] == position
        seen = {n for n, o in named.items() if o["start"] < r["start"] < o["attend_until"]}
        assert seen == ancestors


def test_chats_without_an_id_clashing_names_and_long_turns(spark):
    path, long = vocabulary("byte_bpe_50k.json"), "é <| \\ " * 40_000
    rows = [(None, 0, "user", "a", 1, 2), (None, 0, "user", "a", 1, 2), (None, 1, "assistant", "b", 1, 2), (9, 0, "assistant", long, 1, 2), (9, None, None, None, 1, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, `node.x` int, PATH int")
    nodes, members = chat.build(df, path)
    got = chat.digests(nodes, members, path).collect()
    assert sorted((r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in got) == [(0, 1, 0), (0, 1, 0), (0, 1, 1), (9, 2, len(long))]
    nine = next(r for r in got if r["conv_id"] == 9)
    assert nine["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest() and nine["turns_sha256"] == hashlib.sha256(f"\n\nassistant\n{long}\n".encode()).hexdigest()


def test_token_bytes_are_what_the_library_decodes():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    spec = open(path, encoding="utf-8").read()
    said, library = chat.token_bytes(spec), Tokenizer.from_str(spec)
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(len(said)) for _ in range(rng.randrange(1, 9))]
        assert b"".join(said[i] for i in ids).decode(errors="replace") == library.decode(ids, skip_special_tokens=False)


def test_no_chats(spark):
    path = vocabulary("byte_bpe_50k.json")
    nodes, members = chat.build(conversations(spark, []), path)
    assert nodes.count() == members.count() == chat.digests(nodes, members, path).count() == 0


# Pages, archive

PAGE = """<!DOCTYPE html><html><head><title>T</title></head><body class="home"><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="post-{n}"><h2>Title &amp; more</h2><p><b>One  two<br>three <a href="x>y">link</a> and some more words of the text<p>A second block&nbsp;here<ul><li>a<li>b</ul><form><input> f</form><div class="ad">buy</div>
<script>var a="<p>";</script><style>x</style></div><aside>side</aside><section class="comments"><p>many words of a reader who has something to say about all this</p></section></div><footer>f</footer></body></html>"""


def test_main_text_of_pages(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.format(n=k)) for k in range(5)] + [(10, None, None), (11, "x", ""), (12, "http://b.example", "plain &lt;text&gt; &am"), (13, "http://b.example", "<p>cut <a hr")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("x", "x")
    got = {r["page_id"]: r for r in pages.main_texts(df).collect()}
    for k in range(5):
        assert got[k]["text"] == "Title & more\nOne two three link and some more words of the text\nA second block here\na\nb"
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert (got[10]["text"], got[11]["text"], got[12]["text"], got[13]["text"]) == ("", "", "plain <text> &am", "cut")
    assert {tuple(r["paths"]) for r in pages.winning_paths(df).where("host = 'a.example'").collect()} == {("body.home/div/div.post-#".replace("body.home", "body"),)}


@pytest.mark.parametrize("given", ['aria-hidden="false"', 'title="a hidden place"', 'data-id="menu"', "data-role=menu x='id=menu'"])
def test_attributes_are_whole_names(given):
    assert pages._attributes(f" {given} class='a b' ID=c") == (["a", "b"], "c", "", False)
    assert pages._attributes(f" {given} hidden/")[3] and pages._attributes(" hidden")[3] and pages._attributes(' hidden="" role="menu"')[2:] == ("menu", True)


def slow_main_text(source):
    """A plain reader of well-formed pages: the words below the article, but for what is left out by tag, name or role."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.blocks, self.pieces = [], [], []

        def flush(self):
            text = " ".join("".join(self.pieces).split())
            if text and all(keep for _, keep, _ in self.open) and any(tag == "article" for tag, _, _ in self.open):
                self.blocks.append(text)
            self.pieces = []

        def handle_starttag(self, tag, attrs):
            if tag in pages.INLINE:
                return
            self.flush()
            given = dict(attrs)
            words = {w for v in (given.get("class") or "", given.get("id") or "") for w in re.split("[^a-z]+", v)}
            keep = tag not in pages.NEVER | {"script", "style"} and not words & pages.NAMES and given.get("role") not in pages.ROLES
            self.open.append((tag, keep, None))

        def handle_endtag(self, tag):
            if tag not in pages.INLINE:
                self.flush()
                self.open.pop()

        def handle_data(self, data):
            self.pieces.append(data)

    reader = Reader()
    reader.feed(source)
    return "\n".join(reader.blocks)


def random_page(rng):
    def inside(depth):
        out = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.choice(["p", "div", "section", "ul", "nav", "aside", "script", "form"])
            names = rng.choice(["", "", " class='ad box'", " class='post-7 lead'", " id=comments", " role='navigation'", " title='menu'"])
            if kind == "script":
                out.append("<script>var a = '<p>no</p>';</script>")
            elif kind == "ul":
                out.append(f"<ul{names}>" + "".join(f"<li>{prose(rng, 3)} &amp; <i>{prose(rng, 1)}</i></li>" for _ in range(3)) + "</ul>")
            elif depth and kind in ("div", "section", "nav", "aside", "form"):
                out.append(f"<{kind}{names}>{inside(depth - 1)}</{kind}>")
            else:
                out.append(f"<p{names}>{prose(rng, 8)}\n <b>{prose(rng, 2)}</b> &lt;x&gt;</p>")
        return "".join(out)

    return f"<html><body><nav>{prose(rng, 9)}</nav><article><h1>{prose(rng, 4)}</h1><p>{prose(rng, 30)}</p>{inside(3)}</article><footer>{prose(rng, 9)}</footer></body></html>"


def test_main_text_against_a_plain_reader(spark):
    rng = random.Random(41)
    sources = [random_page(rng) for _ in range(120)]
    rows = [(k, f"http://h{k % 3}.example/{k}", s, 1, 2) for k, s in enumerate(sources)] + [(None, None, sources[0], 1, 2)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `paths.x` int, HOST int")
    got = pages.main_texts(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == slow_main_text(sources[r["page_id"] or 0])


def test_pages_nested_by_the_thousand_and_ties(spark):
    rows = []
    for k, tag in enumerate(["div", "ul", "li", "section", "table><tr><td"]):
        rows.append((k, "http://deep.example", f"<{tag}>" * 30_000 + "the end" + "</x>" * 30_000))
    long = " ".join(["word"] * 400_000)
    rows += [(20, "http://long.example", f"<p>{long}"), (30, "http://even.example", "<div class=a><p>one two</div><div class=b><p>two one</div>")]
    ties = ["<article class=b><p>one</article>", "<article class=a><p>two</article>", "<article class=b><p>x y z</article><article class=a><p>y</article>", "<article class=a><p>two</article>"]
    rows += [(40 + k, "http://tie.example", s) for k, s in enumerate(ties)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.main_texts(df).collect()}
    assert all(got[k] == "the end" for k in range(5)) and got[20] == long
    assert got[30] == "one two\ntwo one"  # the body comes before the containers in it that are worth as much
    assert [got[40 + k] for k in range(4)] == ["one", "two", "y", "two"]  # of the host's two paths with two votes each the smaller wins
    assert pages.main_texts(df.limit(0)).count() == 0


def test_archive_round_trip(spark):
    big = "é" * 80
    rows = [(3, "u", big), (1, "u\r\nX: y", big), (2, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", big + "!"), (7, "u", big)]
    path = f"{shared_dir(spark)}/archive-test-{random.random()}"
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        1: ("response", None), 3: ("revisit", 1), 7: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None),
    }
    for k, _, text in rows:
        payload = (text or "").encode()
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert {r["url"] for r in got.values()} == {"u", "u\r\nX: y", None}
    rebuilt = {r["page_id"]: r for r in warc.rebuild(spark, path).collect()}
    for k, _, text in rows:
        head, _, body = bytes(rebuilt[k]["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        assert body == (b"" if rebuilt[k]["record_type"] == "revisit" else (text or "").encode()) + b"\r\n\r\n"
        assert bytes(rebuilt[k]["payload"]) == (text or "").encode()
    assert spark.read.parquet(f"{path}/payloads").count() == 4


FORGED = "http://a.example/%41 \u0085WARC-Payload-Digest: sha256:" + "0" * 64
URLS = [
    FORGED, "http://b.example/\u2028WARC-Refers-To: <urn:page:77>\u2028WARC-Type: revisit", "a\nWARC-Type: revisit\r\n\r\n", "X-Target-URI-Escaped: form", "", None, "é %0D%0A + &", "\x00\x7f\t",
]


def test_no_url_forges_a_header(spark):
    rows = [(k, u, f"page {k} " * 40, 1, 2) for k, u in enumerate(URLS)] + [(100 + k, u, "page 0 " * 40, 1, 2) for k, u in enumerate(URLS)] + [(None, "u", "page 1 " * 40, 1, 2), (3, "again", "x", 1, 2)]
    path = f"{shared_dir(spark)}/archive-test-{random.random()}"
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string, digest int, `a.b` int"), path)
    got = {(r["page_id"], r["url"]): r for r in warc.read_archive(spark, path).collect()}
    assert set(got) == {(r[0], r[1]) for r in rows} and len(got) == len(rows)
    for page_id, url, text, *_ in rows:
        r = got[page_id, url]
        assert r["payload_digest"] == hashlib.sha256(text.encode()).hexdigest()
        revisit = page_id is None or page_id >= 100
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1 if page_id is None else 0) if revisit else ("response", None))


def test_an_archive_that_lacks_a_payload_is_an_error(spark):
    path = f"{shared_dir(spark)}/archive-test-{random.random()}"
    warc.write_archive(spark.createDataFrame([(1, "u", "one" * 50), (2, "u", "two" * 50)], "page_id long, url string, html string"), path)
    stored = spark.read.parquet(f"{path}/payloads").collect()
    for kept in (stored[:1], [(stored[0]["digest"], b"other"), stored[1]]):
        spark.createDataFrame(kept, "digest binary, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
        with pytest.raises(Exception, match="no payload of a record's digest"):
            warc.read_archive(spark, path).collect()


def test_an_empty_archive(spark):
    path = f"{shared_dir(spark)}/archive-test-{random.random()}"
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == warc.rebuild(spark, path).count() == 0


# Passages


def test_passages_that_repeat_are_found_and_cut(spark):
    rng = random.Random(9)
    own = [prose(rng, 200, "abcdefghijklmnop") for _ in range(12)]
    passage = prose(rng, 60, "abcdefghijklmnop").split()
    fuzzy = passage.copy()
    for at in (20, 40):
        fuzzy[at] = "changed"
    short = prose(rng, 25, "abcdefghijklmnop")
    texts = [(i, f"{t} {short}") for i, t in enumerate(own)]
    texts[2] = (2, own[2] + "\n" + " ".join(passage) + "\n" + own[3][:100])
    texts[5] = (5, own[5] + " " + " ".join(passage).upper() + " tail")
    texts[7] = (7, own[7] + " " + " ".join(fuzzy) + " tail")
    texts += [(20, own[0]), (21, None), (22, ""), (23, "of the of the " * 300), (None, own[1])]
    found = substring.passages(documents(spark, texts)).collect()
    pairs = {(r["doc_id"], r["source_doc_id"]) for r in found}
    assert {(5, 2), (7, 2), (20, 0)} <= pairs and {p[0] for p in pairs} == {5, 7, 20}
    five = next(r for r in found if (r["doc_id"], r["source_doc_id"]) == (5, 2))
    assert five["start_word"] == 200 and five["end_word"] == 260 and five["matched_words"] == 60
    kept = {r["doc_id"]: r for r in substring.cut(documents(spark, texts)).where("doc_id is not null").collect()}
    assert kept[5]["text"] == own[5] + " tail" and kept[5]["n_chars"] == len(kept[5]["text"])
    assert kept[7]["text"] == own[7] + " tail" and kept[20]["text"] == ""
    for i, t in texts:
        if i not in (5, 7, 20, None):
            assert kept[i]["text"] == t
    assert substring.passages(documents(spark, [])).count() == 0


def test_chain_is_the_best_by_quadratic_search():
    rng = random.Random(1)
    several = 0
    for _ in range(200):
        # few diagonals and short steps, so that chains of several segments win and ties occur
        found = sorted({(rng.randrange(80), rng.randrange(80), rng.choice([5, 5, 9, 14])) for _ in range(rng.randrange(1, 20))})
        rows = np.array([(*f, 2) for f in found])
        behind = lambda p, q: p[0] + p[2] - substring.K < q[0] and p[1] + p[2] - substring.K < q[1]
        gap = lambda p, q: substring.GAP * (q[0] - p[0] - p[2] + q[1] - p[1] - p[2] + 2 * substring.K)
        best: list[float] = []
        for i, q in enumerate(found):
            best.append(q[2] + max([0.0, *(best[j] - gap(p, q) for j, p in enumerate(found[:i]) if behind(p, q))]))
        lines = substring.chain(rows)
        assert sorted(k for c in lines for k in c) == list(range(len(found)))
        scores = []
        for c in lines:
            part = [found[k] for k in c]
            assert all(behind(p, q) for p, q in zip(part, part[1:], strict=False))
            scores.append(sum(p[2] for p in part) - sum(gap(p, q) for p, q in zip(part, part[1:], strict=False)))
        reach = substring.LONGEST_GAP + substring.K
        whole = max(best)
        if max(max(f[0] for f in found) - min(f[0] for f in found), max(f[1] for f in found) - min(f[1] for f in found)) <= reach:
            assert abs(scores[0] - whole) < 1e-9
        assert max(scores) <= whole + 1e-9
        if abs(scores[0] - whole) < 1e-9 and len(lines[0]) > 1:
            several += 1
    assert several > 20


def test_segments_are_the_runs_along_diagonals():
    own, other = np.array([0, 3, 60, 7, 200, 45]), np.array([10, 13, 70, 17, 5, 55])
    got = substring.segments(own, other).tolist()
    assert sorted(got) == [[0, 10, 12, 3], [45, 55, 20, 2], [200, 5, 5, 1]]
    assert substring.segments(own[:2], other[:2], np.array([50, 5])).tolist() == [[0, 10, 50, 2]]


def slow_repeats(texts):
    """Words of each document in runs of MIN_WORDS words that an earlier document has as well."""
    n, first, out = substring.MIN_WORDS, {}, defaultdict(set)
    for i, t in texts:
        words = t.lower().split()
        for k in range(len(words) - n + 1):
            if first.setdefault(tuple(words[k : k + n]), i) != i:
                out[i].update(range(k, k + n))
    return out


@pytest.mark.parametrize("times", [1, 4])
def test_no_exact_repeat_is_lost_if_its_parts_stand_elsewhere_first(spark, times):
    rng, texts = random.Random(17), []
    for _ in range(6):
        a, b, c = (prose(rng, n) for n in (40, 40, 25))
        for _ in range(times):  # the parts are first in documents of their own
            texts += [f"{prose(rng, 30)} {p} {prose(rng, 30)}" for p in (a, b, c, f"{a} {c}", f"{c} {b}")]
        texts += [f"{prose(rng, 20)} {p} {prose(rng, 20)}" for p in (f"{a} {b}", f"{b} {c} {a}", a, b, f"{a} {b}", f"{b} {c} {a}")]
    texts = list(enumerate(texts))
    found = substring.passages(documents(spark, texts)).collect()
    words = [t.split() for _, t in texts]
    for r in found:
        assert r["source_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50
        if r["matched_words"] == r["end_word"] - r["start_word"] == r["source_end"] - r["source_start"]:
            assert words[r["doc_id"]][r["start_word"] : r["end_word"]] == words[r["source_doc_id"]][r["source_start"] : r["source_end"]]
    held = defaultdict(set)
    for r in found:
        held[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    wanted = slow_repeats(texts)
    lost = {i: w - held[i] for i, w in wanted.items()}
    assert len(wanted) >= 12 and not any(set(range(k, k + substring.K)) <= w for w in lost.values() for k in w)


def test_workers_get_small_batches(spark):
    name, texts = "spark.sql.execution.arrow.maxRecordsPerBatch", [(i, "a b c") for i in range(1200)]
    for given, most in ((None, 500), (700, 700)):
        spark.conf.unset(name) if given is None else spark.conf.set(name, given)
        substring.passages(documents(spark, texts[:2])).count()
        sizes = documents(spark, texts).coalesce(1).select("doc_id").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert max(r["n"] for r in sizes.collect()) == most
    spark.conf.unset(name)


def test_near_passages_whose_parts_stand_elsewhere_first(spark):
    rng, texts, pairs = random.Random(29), [], []
    for _ in range(20):
        passage = prose(rng, 60, "abcdefghijklmnop").split()
        for at in (0, 12, 25, 38):
            part = " ".join(passage[at : at + 22])
            texts += [f"{prose(rng, 30)} {part} {prose(rng, 30)}" for _ in range(4)]
        near = ["changed" if k % 20 == 10 else w for k, w in enumerate(passage)]
        texts += [f"{prose(rng, 30)} {' '.join(w)} {prose(rng, 30)}" for w in (passage, near)]
        pairs.append((len(texts) - 1, len(texts) - 2))
    found = {(r["doc_id"], r["source_doc_id"]): r for r in substring.passages(documents(spark, list(enumerate(texts)))).collect()}
    assert set(found) == set(pairs)
    assert all(found[p]["start_word"] <= 31 and found[p]["end_word"] >= 89 for p in pairs)


def test_copies_of_a_text_have_its_passages(spark):
    rng = random.Random(31)
    passage, own, short = prose(rng, 60), prose(rng, 70), prose(rng, 30)
    both = f"{own} {passage}"
    texts = [(1, passage), (2, both), (3, both), (3, both), (4, short), (5, short), (6, f"{both} {short}"), (7, both), (7, prose(rng, 80)), (None, both)]
    found = sorted(tuple(r) for r in substring.passages(documents(spark, texts)).collect())
    part = (70, 130, 1, 0, 60, 60)
    assert found == sorted([(2, *part), (3, *part), (3, 0, 130, 2, 0, 130, 130), (6, *part), (6, 0, 130, 2, 0, 130, 130), (7, *part), (7, 0, 130, 2, 0, 130, 130)])


def test_a_loose_chain_is_cut_into_its_alike_parts(spark):
    rng = random.Random(11)
    parts = [prose(rng, 55) for _ in range(10)]
    texts = [(0, " ".join(parts)), (1, " ".join(f"{p} {prose(rng, 20, 'hijklmn')}" for p in parts))]
    found = substring.passages(documents(spark, texts)).collect()
    held = {w for r in found for w in range(r["start_word"], r["end_word"])}
    assert {75 * k + w for k in range(10) for w in range(55)} <= held
    assert all(r["matched_words"] >= 0.8 * (r["end_word"] - r["start_word"]) and r["source_doc_id"] == 0 for r in found)


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    bad = ["vile", "rotten", "awful"]
    texts, labels = [], []
    for i in range(1500):
        toxic = int(rng.random() < 0.3)
        words = prose(rng, 40).split()
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    texts += [(5000, None), (5001, ""), (None, "x")]
    label_rows = spark.createDataFrame([*labels, (7777, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(documents(spark, texts), label_rows).collect()
    truth = dict((i, y) for i, _, y in labels)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len(rows) == len(texts)
    none = toxicity.classify(documents(spark, texts[:3]), label_rows.limit(0)).collect()
    assert {round(r["score"], 6) for r in none} == {0.5}


def plain_ftrl(rows, epochs):
    """FTRL-proximal as published, a coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if i == "bias":
            return -z[i] / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA)
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for at, label in rows:
            held = {i: weight(i) for i in (*at, "bias")}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(held.values()))))) - label
            for i, w in held.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w
                n[i] += g * g
    return {i: w for i in z if i != "bias" and (w := weight(i))}, weight("bias")


def test_training_is_plain_ftrl(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.4)
    rng = random.Random(19)
    rows = []
    for _ in range(150):
        label = rng.randrange(2)
        rows.append((toxicity.slots((prose(rng, 12, "abc") + (" vile" if label else " kind")).encode()), float(label)))
    wanted, bias = plain_ftrl([(a.tolist(), y) for a, y in rows], 3)
    found, found_bias = toxicity.train(rows, 3)
    assert found_bias == pytest.approx(bias)
    assert {int(i) for i in np.flatnonzero(found)} == set(wanted) and 5 < len(wanted) < sum(len(a) for a, _ in rows)
    assert all(found[i] == pytest.approx(w) for i, w in wanted.items())


def test_training_rows_are_bounded_and_repeats_count_once(spark):
    rng = random.Random(29)
    texts = [(i, ("vile " if i % 2 else "kind ") * 3 + prose(rng, 10)) for i in range(200)]
    label_rows = spark.createDataFrame([(i, 1, i % 2) for i, _ in texts], "doc_id long, quality int, toxic int")
    more = texts + [(i, t) for i, t in texts for _ in range(2)]
    once, thrice = (sorted(map(tuple, toxicity.fit(documents(spark, t), label_rows).collect())) for t in (texts, more))
    assert once == thrice
    long = [*texts, (1001, " ".join(f"w{k}" for k in range(200_000)))]
    rows = toxicity.classify(documents(spark, long), label_rows.union(spark.createDataFrame([(1001, 1, 1)], "a long, b int, c int"))).collect()
    assert len(rows) == 201 and toxicity.classify(documents(spark, []), label_rows).count() == 0


def test_long_training_rows_keep_all_slots_in_memory_and_file(monkeypatch):
    text = " ".join(f"w{k}" for k in range(9000)).encode()
    whole = toxicity.slots(text)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([1], pa.int32()), pa.array([5])], names=["doc_id", "text", "label", "hash"])
    (given,) = toxicity._slot_rows([batch])
    assert np.frombuffer(given.column(1)[0].as_py(), np.int32).tolist() == whole.tolist() and len(whole) > 1 << 13
    rng = random.Random(31)
    many = [(toxicity.slots(prose(rng, 30).encode()), float(k % 2)) for k in range(40)]
    monkeypatch.setattr(toxicity, "HELD_BYTES", 500)
    rows = toxicity.Rows()
    for at, label in many:
        rows.add(at.tobytes(), label)
    assert rows.file is not None and rows.held
    for _ in range(2):
        assert [(a.tolist(), y) for a, y in rows] == [(a.tolist(), y) for a, y in many]


# Licences


def test_licences_and_inheritance(spark):
    files = [
        (1, "/a/LICENSE", "Released under the MIT License"), (2, "/a/x.txt", "nothing here"), (3, "/a/b/c/y.txt", "words\nLicensed under the Apache License, Version 2.0.\nmore"), (4, "/a/b/z.txt", None),
        (5, "/q/w.txt", "the license of the poet is under the moon"), (6, None, "Licensed under CC BY-NC 4.0."), (7, "/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (8, "/a/b/c/d/e.txt", ""), (9, "top.txt", "x"),
    ]
    got = {r["id"]: (r["licence"], r["origin"], r["licence_dir"]) for r in licenses.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "own", None) and got[3] == ("Apache-2.0", "own", None) and got[6] == ("CC-BY-NC-4.0", "own", None) and got[7] == ("GPL-3.0", "own", None)
    assert got[2] == ("MIT", "inherited", "/a") and got[4] == ("GPL-3.0", "inherited", "/a/b") and got[8] == ("GPL-3.0", "inherited", "/a/b")
    assert got[5] == got[9] == (None, "none", None)
    assert licenses.scan(spark.createDataFrame([], "id long, path string, text string")).count() == 0


BSD_2 = f"Copyright (c) 2020, Ann\nAll rights reserved.\n\n{licenses.BSD_HEAD}\n\n{licenses.BSD_TAIL}"
BSD_3 = f"Copyright (c) 2021, Bob\n\n{licenses.BSD_HEAD}\n\n{licenses.BSD_NAMES}\n\n{licenses.BSD_TAIL}"


def whole_licence(name):
    return (licenses.TEXTS / f"{name}.txt").read_text(encoding="utf-8")


def fsf_header(what, name, version):
    grant, rest = (x.format(what=what, name=name, version=version) for x in (licenses.GNU_GRANT, licenses.GNU_REST))
    return "\n".join(f"# {line.strip()}" for line in f"a.py\nCopyright 2001 Ann\n{grant}\n{rest}".split("\n")) + "\nimport os\n"


def test_licence_texts_and_headers(spark):
    rng = random.Random(31)
    affero = whole_licence("GPL-3.0").replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("GNU General Public License", "GNU Affero General Public License")
    affero = f"{affero[:-4000]}\n\n{licenses.AFFERO}"
    english = " ".join(rng.choice("the of and to a in is it that for with on as are this by be or not was we you can from have if one all which will other use".split()) for _ in range(800))
    files = {
        "/a/COPYING": (whole_licence("GPL-3.0"), "GPL-3.0"), "/b/COPYING": (whole_licence("GPL-2.0"), "GPL-2.0"), "/c/LICENSE": (BSD_2, "BSD-2-Clause"), "/d/LICENSE": (BSD_3, "BSD-3-Clause"),
        "/e/LICENSE.txt": (whole_licence("Apache-2.0"), "Apache-2.0"), "/f/COPYING": (whole_licence("LGPL-2.1"), "LGPL-2.1"), "/g/COPYING": (affero, "AGPL-3.0"), "/h/LICENSE": (whole_licence("MPL-2.0"), "MPL-2.0"),
        "/i/LICENSE": ("Copyright 2020 Ann\n\n" + dict(licenses.HEADERS)["MIT"], "MIT"), "/j/LICENSE": (dict(licenses.HEADERS)["ISC"], "ISC"), "/k/COPYING.LESSER": (whole_licence("LGPL-3.0"), "LGPL-3.0"),
        "/s/a.py": (fsf_header("program", "General Public License", "3"), "GPL-3.0"), "/s/b.py": (fsf_header("program", "General Public License", "2"), "GPL-2.0"),
        "/s/c.py": (fsf_header("library", "Lesser General Public License", "2.1"), "LGPL-2.1"), "/s/d.py": ("# SPDX-License-Identifier: EPL-2.0\nx = 1", "EPL-2.0"), "/s/e.py": (english, None), "/t/LICENSE": (english, None),
        "/a/x/y.c": ("int x;", "GPL-3.0"), "/c/q.c": (None, "BSD-2-Clause"), "/s/f.py": ("  \n\n", None),
    }
    rows = [(k, path, text, 1, 2) for k, (path, (text, _)) in enumerate(files.items())]
    rows += [(500 + k, f"/n/{k}.txt", prose(rng, 60, "abcdefghijklmnop"), 1, 2) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, path string, text string, _licence int, `near.b` int")
    got = {r["path"]: r["licence"] for r in licenses.scan(df).collect()}
    assert {p: got[p] for p in files} == {p: licence for p, (_, licence) in files.items()}
    assert all(got[f"/n/{k}.txt"] is None for k in range(60))


def slow_cosines(files, whole):
    """Best (kind, cosine, licence) of every text against all templates, without any pruning."""
    weights, other = whole
    out = []
    vectors = licenses.vectors_of(weights)
    for path, text in files:
        found = []
        named = bool(re.search(licenses.LICENCE_FILE, path))
        for kind, units in enumerate((text.split("\n"), re.split("\n[ \t\r]*\n", text), [text] if named else [])):
            for unit in units:
                counts = Counter(licenses.terms(unit))
                own = {t: (1 + math.log(n)) * weights.get(t, other) for t, n in counts.items()}
                norm = math.sqrt(sum(w * w for w in own.values()))
                for licence, size, vector in vectors:
                    cosine = round(sum(w * own.get(t, 0) for w, t in vector) / norm, 6) if norm else 0
                    if size <= kind and cosine >= licenses.THRESHOLD:
                        found.append((-kind, -cosine, licence))
        out.append(min(found) if found else None)
    return out


def test_licence_pruning_loses_nothing(spark):
    rng = random.Random(37)
    vocabulary_of = sorted({t for _, kind, text in licenses.templates() if kind < licenses.WHOLE for t in licenses.terms(text)})
    files = []
    for k in range(60):
        _, _, text = rng.choice([t for t in licenses.templates() if t[1] < licenses.WHOLE])
        words = [w for w in text.split() if rng.random() < 0.8] + rng.choices(vocabulary_of, k=rng.randrange(12))
        files.append((f"/d{k}/" + rng.choice(["LICENSE", "x.c"]), "\n".join([prose(rng, 5), " ".join(words), "", prose(rng, 9)])))
    df = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(files)], "id long, path string, text string")
    wanted = slow_cosines(files, licenses.term_weights(df))
    got = {r["id"]: (r["licence"], r["cosine"]) for r in licenses.own_licences(df).collect()}
    assert got == {k: (w[2], -w[1]) for k, w in enumerate(wanted) if w}
    assert 20 < len(got)


# Pipeline


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    item = prose(rng, 30, "mnopqrs")
    clean = [(i, prose(rng, 150, "abcdefghijklm")) for i in range(20)]
    texts = clean + [(50, clean[0][1]), (51, "junk " * 100), (52, "short"), (53, prose(rng, 100) + " " + item), (54, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [i for i, _ in clean]
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and corpus_pipeline.ORACLE_SQL is None


def slow_verdict(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, chars, symbols, same_lines, repeated = slow_metrics(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper = sum(unicodedata.category(c) == "Lu" for w in words for c in w)
    return not (n < 10 or 100 * repeated > 20 * n or 10 * symbols > n or 10 * upper > 4 * chars or chars < 2 * n or chars > 15 * n or 2 * same_lines > len(lines))


def slow_pipeline(rows, items, library):
    """The five stages in plain Python, for texts with single spaces and exact repeats."""
    rows = [r for r in rows if slow_verdict(r[1])]
    component = slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    rows = [(i, t) for i, t in rows if component[i] == i]
    gone = slow_repeats(rows)
    rows = [(i, " ".join(w for k, w in enumerate(t.split()) if k not in gone[i]) if gone[i] else t) for i, t in rows]
    rows = [(i, t) for i, t in rows if not slow_contamination(t, items)[4]]
    out = []
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        out.append((i, len(ids), ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, _SPANS int, Rejected_By string, _0 int, doc int"


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(47)
    item, passage, second = prose(rng, 30, "mnopqrs"), prose(rng, 60, "abcdefghijklmnop"), prose(rng, 80, "abcdefghijklmnop")
    own = [(i, prose(rng, rng.randrange(120, 260), "abcdefghijklmnop")) for i in range(24)]
    texts = [(i, f"{t} {passage} {prose(rng, 40, 'abcdefghijklmnop')}" if i % 6 == 1 else f"{t} {second}" if i % 6 == 2 else t) for i, t in own]
    near = own[0][1].split()
    near[50] = "zz"
    texts += [(60, own[3][1]), (61, " ".join(near)), (62, "junk " * 100), (63, "short"), (64, f"{prose(rng, 100)} {item}"), (65, f"{prose(rng, 900)} {item}"), (66, None), (67, "A " * 5 + "### $$$ " * 20), (68, f"{passage} {second}")]
    columns = [(i, t, "en", "s", len(t or ""), "x", 3, "no", 4, 5) for i, t in texts]
    spark.createDataFrame(columns, PIPELINE).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, item), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"], r["n_tokens"], list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    wanted = slow_pipeline(texts, items, Tokenizer.from_file(vocabulary("word_bpe_49k.json")))
    assert [r[0] for r in got] == [r[0] for r in wanted]
    assert got == wanted
    assert {i for i, *_ in got} >= {0, 7, 8, 65} and not {60, 62, 63, 64, 66, 67} & {i for i, *_ in got}


def test_pipeline_over_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], PIPELINE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("text", ["a &amp; b", "&#65;&lt", "x &copy y"])
def test_references_are_decoded_as_in_html(text):
    assert pages.extract(f"<p>{text}</p>", []) == html.unescape(text)

"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from biotally.llm import chat, decontam, html_main, line_dedup, mixing, pii, quality_model, quality_rules, simhash, text_model, toxicity
from biotally.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "the and re in ti on er st le ou ha wh ea or ed".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, component_id string, _id int, key int, target string"


def prose(r, n):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def documents(spark, texts, start=0):
    rows = [(start + k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, None, "x", "y", 1, 2, "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(5)
    base = prose(r, 60)
    return [None, "", " \n\t ", "One", "one", "É x y zé", "a b", base, base, base + " more", "  lead " + base, prose(r, 30000), "x\n" * 50, "#$% " * 40, "no break" * 3000, base.upper(), "word " * 100, "ß" * 50 + "\n\n" + base]


@pytest.fixture(scope="module")
def odd(spark, odd_texts):
    docs = documents(spark, odd_texts)
    return docs.unionByName(docs.where("doc_id in (7, 11)")).unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))


# 1. SimHash


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            parent[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


def test_simhash_against_plain_version(spark, odd):
    r = random.Random(2)
    base = [prose(r, 400) for _ in range(6)]
    near = []
    for b in base:
        for _ in range(6):
            words = b.split()
            words[r.randrange(len(words))] = "changed"
            near.append(" ".join(words))
    docs = odd.unionByName(documents(spark, base + near, 100))
    got = simhash.simhash_components(docs)
    plain = [(x["doc_id"], plain_fingerprint(x["text"])) for x in docs.collect()]
    roots = plain_components([i for i, _ in plain], [f for _, f in plain], 2)
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(plain, roots, strict=True)), key=lambda t: tuple((x is not None, x) for x in t))
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_components(odd.limit(0)).count() == 0


def test_ball_links_connect_all_within_radius(spark):
    r = random.Random(3)
    prints = {r.getrandbits(64) for _ in range(40)}
    for f in list(prints):
        for _ in range(4):
            prints.add(f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    found = components(links).collect()
    got = {x["node"]: x["root"] for x in found}
    want = plain_components(signed, [f & (1 << 64) - 1 for f in signed], 2)
    assert [got.get(f, f) for f in signed] == want


def test_similar_components_find_copies_and_leave_others(spark, odd):
    r = random.Random(4)
    texts = [prose(r, 300) for _ in range(40)]
    copies = [" ".join(w if k % 97 else "edit" for k, w in enumerate(t.split())) for t in texts]  # five-word similarity about 0.9
    got = dict(rows_of(simhash.similar_components(documents(spark, texts + copies, 1000)), "doc_id", "component_id"))
    assert sum(got[1040 + k] == got[1000 + k] for k in range(40)) >= 36
    assert len({got[1000 + k] for k in range(40)}) == 40
    assert simhash.similar_components(odd).count() == odd.count()


def test_similar_components_inside_a_family_that_shares_a_passage(spark):
    r = random.Random(21)
    shared = prose(r, 200)
    family = [shared + " " + prose(r, 80) for _ in range(2000)]  # five-word similarity about 0.5
    copies = [" ".join(w if k % 61 else "edit" for k, w in enumerate(t.split())) for t in family[:300]]
    texts = family + copies
    prints = simhash._fingerprints(pa.array(texts), 5, 5)
    mask = np.uint64((1 << simhash.NARROW) - 1)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts) - 1):  # all that meet in a narrow value and lie close on all bits
        apart = prints[i + 1 :] ^ prints[i]
        meet = sum((np.bitwise_count(apart >> np.uint64(simhash.NARROW * half) & mask) <= simhash.RADIUS).any(axis=1) for half in (0, 1)) > 0
        for j in np.flatnonzero(meet & (np.bitwise_count(apart).sum(axis=1) <= simhash.similarity_bits(0.8, 320))) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    got = dict(rows_of(simhash.similar_components(documents(spark, texts)), "doc_id", "component_id"))
    assert [k for k in range(len(texts)) if got[k] != find(k)] == []
    assert sum(got[2000 + k] == got[k] for k in range(300)) >= 270


def test_tiles_of_a_value_meet_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 7)
    r = random.Random(22)
    base = [r.getrandbits(62) for _ in range(20)]
    nodes = [(k, k, base[k % 20] ^ (1 << k // 20)) for k in range(60)]
    links = simhash._all_meetings(spark.createDataFrame([(v, k + 1, k) for v in (1, 2) for k in range(60)], "value long, place int, node long"), spark.createDataFrame(nodes, "node long, near long, s0 long"), ["s0"], 2)
    got = {x["node"]: x["root"] for x in components(links).collect()}
    assert got == {k: k % 20 for k in range(60)}


def test_components_of_chains_hubs_and_nothing(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(50)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[100 + k] == 100 for k in range(1, 50))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 2. Chat


def test_escape_is_reversible():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(["\\", "#", "###", "</turn>", " ", "\n", "a", ":", " </turn>\n", "### x: "]) for _ in range(r.randint(0, 8)))
        formatted, lo, hi = chat.format_turn(text, text)
        assert chat.parse(formatted) == [(text, text)] and chat.unescape(formatted[lo:hi]) == text


def conversations(spark):
    r = random.Random(6)
    rows, shared = [], [("system", "be good"), ("user", "hello ### x: \\"), ("assistant", "hi </turn>\n")]
    for c in range(30):
        turns = shared[: r.randint(0, 3)] + [(r.choice(["user", "assistant"]), r.choice(["a", "b", None, "### Assistant: </turn>"])) for _ in range(r.randint(1, 4))]
        rows += [(c, k, role, text, "extra", 1) for k, (role, text) in enumerate(turns)]
    rows += [(None, 0, None, None, "e", 1), (None, 0, None, None, "e", 1)]
    rows += [(50, k, "user", str(k % 3), "e", 1) for k in range(400)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string, path int")


@pytest.mark.parametrize("tokenizer", [None, "/opt/tokenizers/byte_bpe_50k.json"])
def test_prefix_forest(spark, tokenizer):
    if tokenizer and not __import__("os").path.exists(tokenizer):
        pytest.skip("no tokenizer file")
    turns = conversations(spark)
    forest, leaves = chat.prefix_forest(turns, tokenizer)
    said = {}
    for x in turns.collect():
        said.setdefault(x["conv_id"], []).append((x["turn"], x["role"] or "", x["text"] or ""))
    nodes = {x["node"]: x for x in forest.collect()}
    ends = {x["conv_id"]: x["node"] for x in leaves.collect()}
    assert set(ends) == set(said)
    prefixes = {tuple((r, t) for _, r, t in sorted(v))[:k] for v in said.values() for k in range(1, len(v) + 1)}
    assert len(nodes) == len(prefixes)  # shared turns once
    for conv, end in ends.items():
        chain, node = [], nodes[end]
        while node is not None:
            chain.insert(0, node)
            node = nodes.get(node["parent"])
        assert chat.parse("".join(n["segment"] for n in chain)) == [(r, t) for _, r, t in sorted(said[conv])]
        position = 0
        for k, n in enumerate(chain):
            assert n["position"] == position and n["depth"] == k
            position += n["n_tokens"]
            allowed = sorted(t for i in n["attends"] for t in range(i["start"], i["stop"]))
            assert allowed == sorted(t for a in chain[:k] for t in range(a["start"], a["start"] + a["n_tokens"]))
    for root in {n["root"] for n in nodes.values()}:
        tree = sorted((n["start"], n["n_tokens"], n["seq"]) for n in nodes.values() if n["root"] == root)
        at = 0
        for k, (start, n, seq) in enumerate(tree):
            assert start == at and seq == k
            at += n
    if not tokenizer:
        for x in chat.read_back(forest, leaves).collect():
            turns_said = [(r, t) for _, r, t in sorted(said[x["conv_id"]])]
            loss = "".join(t for r, t in turns_said if r == "assistant")
            assert (x["n_turns"], x["turns_sha256"]) == (len(turns_said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns_said).encode()).hexdigest())
            assert (x["loss_chars"], x["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert x["formatted_chars"] == sum(len(chat.format_turn(r, t)[0]) for r, t in turns_said)
        none, no_leaves = chat.prefix_forest(turns.limit(0))
        assert none.count() == 0 and chat.read_back(none, no_leaves).count() == 0


# 3. Personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = kind == 0 or (kind == 1 and all(int(p) <= 255 for p in m.group().split("."))) or (kind == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == 3 and 9 <= len(digits) <= 15)
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    r = random.Random(1)
    for _ in range(20000):
        text = "".join(r.choice("aB0123459.@+-() _%\n") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    long = "7" * 200000 + " " + "a" * 200000 + "@b.c " + "+1" + " " * 50000
    assert pii.base_spans(long)[0][1] == 0


def test_field_spreads_labels_to_repeated_and_similar_pieces(spark, odd):
    texts = ["call +1 (487) 555-7209 now. Later (487) 555-7209 or 5557209, order 12345", "mail bob.s7@x.org; bob.s7 said so. In 2020 at 10:30", "1111111 and 1111111 and 5557209", "7536784127813050 4845168114407329 then 4845168114407329"]
    found = {x["doc_id"]: x for x in pii.find_personal_data(documents(spark, texts)).collect()}
    pieces = lambda k: [(s.split(":")[0], texts[k][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in found[k]["spans"].split(",") if s]
    assert pieces(0) == [("phone", "+1 (487) 555-7209"), ("phone", "(487) 555-7209"), ("phone", "5557209")]
    assert pieces(1) == [("email", "bob.s7@x.org"), ("email", "bob.s7")]
    assert pieces(2) == []
    assert pieces(3) == [("card", "4845168114407329")] * 2
    got = {x["doc_id"]: x for x in pii.find_personal_data(odd).collect()}
    assert got[0]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(odd.limit(0)).count() == 0
    clean = pii.redacted(documents(spark, [*texts, None, ""]))
    assert clean.columns == [c.split()[0] for c in DOCS.split(", ")]
    by = {x["doc_id"]: x["text"] for x in clean.collect()}
    assert by[0].startswith("call <PHONE> now. Later <PHONE> or <PHONE>, order 12345") and by[4] is None and by[5] == ""


# 4. Benchmark decontamination


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for k, y in enumerate(b, 1):
            above, row[k] = row[k], above + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_common_subsequence():
    r = random.Random(8)
    for _ in range(300):
        a, b = [r.randrange(6) for _ in range(r.randint(1, 90))], [r.randrange(6) for _ in range(r.randint(0, 120))]
        assert decontam.common_subsequence(decontam._masks(np.array(a)), len(a), b) == plain_lcs(a, b)


def test_leaks(spark, odd):
    r = random.Random(9)
    items = [prose(r, r.randint(14, 90)) + ". " + prose(r, 6) + "." for _ in range(40)]
    clean = [prose(r, 400) for _ in range(60)]
    texts, want = list(clean), set()
    for k, item in enumerate(items):
        words = item.split()
        if k % 2:  # a paraphrase: every sixth word of the question replaced
            words = [w if j % 6 or j >= len(words) - 6 else "other" for j, w in enumerate(words)]
        at = r.randint(0, 300)
        host = prose(r, 400).split()
        texts.append(" ".join(host[:at] + [w.upper() if k % 3 == 0 else w for w in words] + host[at:]))
        want.add((len(texts) - 1, k))
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)] + [(900, None, 1), (901, "", 1), (902, "the and", 1)], "item_id long, text string, doc_id int")
    got = set(rows_of(decontam.find_leaks(documents(spark, texts), bench), "doc_id", "item_id"))
    assert got == want
    assert decontam.find_leaks(odd, bench).count() == 0
    assert decontam.find_leaks(odd, bench.limit(0)).count() == 0 and decontam.find_leaks(odd.limit(0), bench).count() == 0


# 5. Pages


def test_main_text():
    page = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
    <nav><a>Home</a></nav><div class="content"><h2>Title &lt;3</h2><p>First&nbsp;para <b>bo</b>ld  of a text that is long enough.</p>
    <div class="ad">Buy</div><p>Short.</p><p>Second paragraph with many words in it, so that it counts as text.</p></div>
    <section class="comments"><p>Reader: I disagree with all of this very much indeed.</p></section><form>Subscribe</form><footer>c</footer></body></html>"""
    assert html_main.main_text(page) == "Title <3\nFirst para bold of a text that is long enough.\nShort.\nSecond paragraph with many words in it, so that it counts as text."
    assert html_main.main_text("<nav>a<article><h1>T</h1><p>x<p>y &amp; z<script>var a='</p>'</script></article><footer>f") == "T\nx\ny & z"
    assert [html_main.main_text(t) for t in (None, "", "plain", "<p></p>", "<<<>>>", "<a href='x")] == ["", "", "plain", "", "<<<>>>", "<a href='x"]
    long = "<article>" + "<p>" + "word " * 10 + "</p>" * 1 + "<p>s</p>" * 20000 + "</article>"
    assert html_main.main_text(long).count("\n") == 20000


def test_main_text_keeps_short_runs_of_long_pages():
    long = "<p>" + "word " * 100 + "</p>"
    share, advert = "<div class='share'>Share</div>", "<div class='ad'>Buy</div>"
    title, end = "A heading of some forty characters or so", "closing " * 35
    body = [("word " * 100).strip()] * 3
    for opened, closed in (("<article>", "</article>"), ("<div>", "</div>")):
        page = f"{opened}<h1>{title}</h1>{share}{long * 3}{closed}"
        assert html_main.main_text(page).split("\n") == [title, *body]
        page = f"{opened}<p>{'word ' * 1400}</p>{advert}<p>{end}</p>{closed}"
        assert html_main.main_text(page).split("\n") == [("word " * 1400).strip(), end.strip()]
        page = f"{opened}{long * 3}{advert}<p>Short.</p>{advert}{long * 3}{closed}"
        assert html_main.main_text(page).split("\n") == [*body, "Short.", *body]
    assert html_main.main_text(f"<article>{long * 3}{advert}<p>End.</p></article>").split("\n") == [*body, "End."]


def test_extract_rows(spark):
    rows = [(1, "u", "<p>a b</p>", "t", 3), (1, "u", "<p>a b</p>", "t", 3), (None, None, None, None, None)]
    got = rows_of(html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")), "page_id", "url", "text", "n_chars")
    assert got == [(None, None, "", 0), (1, "u", "a b", 3), (1, "u", "a b", 3)]


# 6. Mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set()
    while True:
        free = [s for s in names if s not in capped]
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def test_mix_meets_targets(spark):
    r = random.Random(10)
    rows = []
    for s, n in (("a", 400), ("b", 1500), ("Ä", 30), ("c", 300), (None, 200), ("d", 300), ("tiny", 2), ("none", 3)):
        rows += [(len(rows) + k, "" if s == "none" else " ".join(["w"] * (1 + int(r.paretovariate(1.2)) % 900)), s, "q", 7) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, taken int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "source", "size", "source_size", "target", "rate", "copies", "taken"}
    sizes, taken, target = {}, {}, {}
    for x in got:
        assert x["size"] == len(WORD.findall(x["text"])) and 0 <= x["copies"] <= 3 and x["taken"] == x["copies"] * x["size"]
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
        target[x["source"]] = x["target"]
    want = plain_targets(sizes)
    for s, t in target.items():
        assert t == pytest.approx(want[s]) and abs(taken[s] - t) <= max(0.01 * t, 60), s
    again = {x["doc_id"]: x["copies"] for x in mixing.mix(docs.repartition(7)).collect()}
    assert again == {x["doc_id"]: x["copies"] for x in got}


def test_mix_odd_rows(spark, odd):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(odd.limit(0)).count() == 0
    counted = odd.select("text", mixing.word_count(F.col("text")).alias("n")).collect()
    assert all(x["n"] == len(WORD.findall(x["text"] or "")) for x in counted)


# 7. Quality classifier


def test_cumulative_link_recovers_thresholds():
    r = np.random.default_rng(0)
    n, f = 6000, 20
    held = r.random((n, f)) < 0.3
    w = np.where(np.arange(f) < 6, [1.5, -1.5] * 10, 0.0)
    y = ((held @ w + r.logistic(size=n))[:, None] > np.array([-1.0, 1.0])).sum(axis=1)
    row, col = np.nonzero(held)
    got, cuts = quality_model.fit_cumulative(y, row, col, f)
    assert np.abs(got - w).max() < 0.3 and np.abs(cuts - [-1.0, 1.0]).max() < 0.3 and cuts[0] < cuts[1]


def graded(spark):
    r = random.Random(11)
    texts = [prose(r, 80) if k % 3 else ("### " + prose(r, 2) + " ") * 30 for k in range(900)]
    labels = [(k, 0 if k % 3 == 0 else 1, int(k % 7 == 0)) for k in range(900)]
    return documents(spark, [t + (" idiot" if y[2] else "") for t, y in zip(texts, labels, strict=True)]), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_graded_documents(spark, odd):
    docs, labels = graded(spark)
    got = quality_model.grade_documents(docs, labels).collect()
    held = [x for x in got if x["held_out"]]
    assert held and all(x["selected"] == (x["doc_id"] % 3 != 0) for x in held)
    assert all(0 <= x["p_grade_2"] <= x["p_grade_1"] <= 1 for x in got)
    assert quality_model.grade_documents(odd, labels).count() == odd.count()
    assert quality_model.grade_documents(odd, labels.limit(0)).count() == odd.count()
    assert quality_model.grade_documents(odd.limit(0), labels).count() == 0


# 8. Line dedup


def plain_removed(rows):
    seen = []
    for doc, text in rows:
        at = 0
        for line in (text or "").split("\n"):
            parts = [(0, at, line)]
            cuts = [0, *(m.end() for m in re.finditer(r"[.!?] ", line)), len(line)]
            if len(cuts) > 2:
                parts += [(1, at + a, line[a:b]) for a, b in itertools.pairwise(cuts) if b > a]
            seen += [(doc, level, s, s + len(p), at, " ".join(WORD.findall(p)).lower()) for level, s, p in parts if len(WORD.findall(p)) >= 5]
            at += len(line) + 1
    first = {}
    for u in seen:
        rank = (u[0] is None, u[0] or 0, u[2])
        first[u[5]] = min(first.get(u[5], rank), rank)
    later = [u for u in seen if first[u[5]] != (u[0] is None, u[0] or 0, u[2])]
    lines = {(u[0], u[4]) for u in later if u[1] == 0}
    return sorted({(u[0], u[2], u[3], u[1]) for u in later if u[1] == 0 or (u[0], u[4]) not in lines}, key=lambda t: (t[0] is not None, t))


def test_removed_spans_against_plain_version(spark, odd):
    r = random.Random(12)
    lines = [prose(r, r.randint(1, 12)) for _ in range(30)]
    texts = ["\n".join(r.choice(lines) + r.choice(["", ". " + r.choice(lines) + "!", " "]) for _ in range(r.randint(1, 9))) for _ in range(60)]
    docs = documents(spark, texts, 200).unionByName(odd)
    spans = line_dedup.removed_spans(docs)
    got = sorted(set(rows_of(spans, "doc_id", "start_char", "end_char", "level")), key=lambda t: (t[0] is not None, t))
    assert got == plain_removed([(x["doc_id"], x["text"]) for x in docs.collect()])
    assert line_dedup.removed_spans(docs.limit(0)).count() == 0
    kept = {x["doc_id"]: x for x in line_dedup.deduplicated(docs.where("doc_id >= 200"), spans).collect()}
    cut = {}
    for d, a, z, _ in got:
        cut.setdefault(d, set()).update(range(a, z))
    for k, text in enumerate(texts, 200):
        assert kept[k]["text"] == "".join(c for i, c in enumerate(text) if i not in cut.get(k, ()))
        assert "".join(text[s["start"] : s["stop"]] for s in kept[k]["kept_spans"]) == kept[k]["text"]


def test_removed_spans_of_rows_that_share_an_id(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven", "red green blue white black grey")
    rows = [(0, 1, f"{a}\n{b}"), (1, 1, c + "!" * 22 + f"\n{a}"), (2, None, f"{a}\nlast"), (3, None, f"{c}{'!' * 22}\nnew"), (4, None, f"{a}\nlast")]
    docs = spark.createDataFrame(rows, "k long, doc_id long, text string")
    spans = line_dedup.removed_spans(docs, key_col="k")
    assert rows_of(spans, "row_key", "start_char") == [(1, len(c) + 23), (2, 0), (3, 0), (4, 0)]
    cut = line_dedup.deduplicated(docs, spans, key_col="k")
    assert rows_of(cut, "k", "text") == [(0, rows[0][2]), (1, rows[1][2][: len(c) + 23]), (2, "\nlast"), (3, "\nnew"), (4, "\nlast")]


# 9. Quality rules


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for v in places.values() if len(v) > 1 for k in v for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_against_plain_version(spark, odd):
    r = random.Random(13)
    texts = ["".join(r.choice(["a b c d e f g h\n", "x#", "é ", "\n", "y y y ", " "]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    docs = documents(spark, texts, 500).unionByName(odd)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = rows_of(quality_rules.text_counts(docs), "doc_id", *names)
    want = sorted(((x["doc_id"], *plain_counts(x["text"])) for x in docs.collect()), key=lambda t: tuple((x is not None, x) for x in t))
    assert got == want


def test_chi_square():
    assert quality_rules.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality_rules.chi2_quantile(0.975, 2) == pytest.approx(7.3778, abs=1e-3)


def test_outliers_go_and_clean_documents_stay(spark, odd):
    r = random.Random(14)
    texts = [prose(r, r.randint(30, 600)) for _ in range(300)] + ["### $$$ " + prose(r, 40).replace(" ", " ### ") for _ in range(30)] + ["short"]
    docs = documents(spark, texts).withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    got = {x["doc_id"]: x for x in quality_rules.quality_rules(docs).collect()}
    assert all(got[k]["kept"] for k in range(300)) and not any(got[300 + k]["kept"] for k in range(31))
    assert got[330]["base_failed"] and not got[300]["base_failed"]
    few = quality_rules.quality_rules(odd).collect()  # too few rows for an estimate: only the base rules speak
    assert len(few) == odd.count() and all(x["kept"] != x["base_failed"] and x["distance"] is None for x in few)
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


# 10. Toxicity


def test_restored_words_and_scores(spark, odd):
    r = random.Random(15)
    said = ["idiot", "clown", "worthless", "stupid"]
    texts = [prose(r, 60) + (f" {r.choice(said)} {r.choice(said)} " if k % 4 == 0 else " ") + prose(r, 20) for k in range(1200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 1) for k in range(1200)] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    hidden = ["the 1d10t and re", "the i d i o t and re", "the cl0wn cl0wn", "w.o.r.t.h.l.e.s.s the", "stuuuupid the and"]
    docs = documents(spark, texts + [prose(r, 30) + " " + h + " " + prose(r, 30) for h in hidden])
    restorer = toxicity.Restorer(toxicity.gram_counts(docs))
    assert [restorer.restore(t) for t in (b"1d10t", b"i d i o t", b"cl0wn", b"w.o.r.t.h.l.e.s.s", b"stuuuupid")] == [b"idiot", b"idiot", b"clown", b"worthless", b"stupid"]
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(docs, labels).collect()}
    assert all(x["predicted"] == int(k % 4 == 0) for k, x in got.items() if k < 1200 and x["held_out"])
    assert all(got[1200 + k]["score"] > 0.5 for k in range(len(hidden)))
    assert toxicity.score_toxicity(odd, labels).count() == odd.count()
    assert all(x["score"] == 0.5 for x in toxicity.score_toxicity(odd, labels.limit(0)).collect())
    assert toxicity.score_toxicity(odd.limit(0), labels).count() == 0


def test_gram_slots_are_the_vectorised_hashes():
    from biotally.llm.words import Hashes

    data = np.frombuffer("the idiot é".encode(), np.uint8)
    for a, b in ((0, 1), (2, 7), (9, 12), (0, 5)):
        assert toxicity._gram_slot(data[a:b].tobytes()) == int(Hashes(data).of(np.array([a]), np.array([b]))[0] >> np.uint64(44))


def test_fit_rows_leave_out_a_fifth(spark):
    import zlib

    got = spark.range(500).select("id", text_model.fit_row(F.col("id")).alias("f")).collect()
    assert all(x["f"] == (zlib.crc32(str(x["id"]).encode()) % 5 != 0) for x in got)

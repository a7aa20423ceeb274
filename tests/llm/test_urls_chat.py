import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import chat, urls

PAGES = [
    (1, "http://example.com/en/1?x#y", "allow com/", ""), (2, None, None, ""), (3, "no scheme", None, ""), (4, "https://Www.Example.COM/en/2", None, ""),
    (5, "http://a.b.net/fr/x/y", None, ""), (6, "http://example.com", None, ""), (7, "ftp://host.org?q=1", None, ""), (8, "http://notexample.com/en/", None, ""),
    (9, "http://cheappills.example.org/en/9", None, ""), (10, "http://blog.example.org/de/1", None, ""), (11, "a://b://c/d", None, ""), (12, "://", None, ""), (1, "http://example.com/en/1?x#y", None, ""),
]
WANT = {
    1: ("example.com", "/en/1", "example.com/en/", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("www.example.com", "/en/2", "www.example.com/en/", "allow"),
    5: ("a.b.net", "/fr/x/y", "net/fr/", "block"), 6: ("example.com", "", None, None), 7: ("host.org", "", None, None), 8: ("notexample.com", "/en/", "com/", "allow"),
    9: ("cheappills.example.org", "/en/9", None, "block"), 10: ("blog.example.org", "/de/1", None, "allow"), 11: ("b:", "//c/d", None, None), 12: ("", "", None, "allow"),
}


def _text(html):
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", html or "")
    text = re.sub(r"&#?\w+;", " ", re.sub(r"(?s)<[^>]*>", " ", text))
    return re.findall(r"[^\W\d_]+", re.sub(r"[\w-]+(\.[\w-]+)+", " ", text).lower())


def brute(rows, seeds=urls.SEEDS):
    """(words, score) of each row (page_id, url, html), one after the other."""
    lexicon = {*urls.LEXICON, *seeds}
    made = re.compile("^(?:" + "|".join(sorted(lexicon)) + "){2,}$")
    counts, parsed = Counter(), []
    for page_id, url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"^[^/?#]*", rest)[0].lower(), re.match(r"^[^/?#]*([^?#]*)", rest)[1]
        words, path_words = _text(html), re.findall(r"[^\W\d_]{2,}", path.lower())
        found = words + path_words + [w for c in host.split(".") for w in re.findall(r"[^\W\d_]+", c) if len(re.findall(r"[^\W\d_]+", c)) > 1]
        counts.update(w for w in found if len(w) <= 63 and (w in lexicon or not made.match(w)))
        abuse, n = sum(w in urls.ABUSE for w in words), len(words)
        evidence = None if not n else abuse >= urls.ABUSE_SHARE * n or (1 - len(set(words)) / n >= urls.REPEATS and n >= 20)
        parsed.append((page_id, host, path_words, evidence, page_id is not None and zlib.crc32(str(page_id).encode()) % 5 == 0))
    floor = max(1, sum(counts.values()) // 10_000)
    for w in lexicon:
        counts[w] += floor
    total = sum(counts.values())

    def cut(label):
        best = (math.inf, [])
        for cuts in itertools.product((0, 1), repeat=max(0, len(label) - 1)):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(label)]
            parts = [label[x:y] for x, y in itertools.pairwise(at)]
            cost = sum(math.log(total / counts[w]) if w in counts else math.log(total + 1) + 2 + 3 * len(w) for w in parts)
            if cost < best[0] - 1e-9:
                best = cost, parts
        return best[1] if all(w in counts for w in best[1]) else [label]

    tokens = [[w for label in re.findall(r"[^\W\d_]+", host) for w in cut(label)] for _, host, *_ in parsed]
    kinds, docs = {False: Counter(), True: Counter()}, Counter()
    names = {w for t, p in zip(tokens, parsed, strict=True) for w in t + p[2]}
    for t, (_, _, path_words, evidence, held) in zip(tokens, parsed, strict=True):
        if evidence is not None and not held:
            kinds[evidence].update(t + path_words)
            docs[evidence] += 1
    size = {k: sum(c.values()) + len(names) + 1 for k, c in kinds.items()}
    odds = lambda w: math.log((kinds[True][w] + 1) / size[True]) - math.log((kinds[False][w] + 1) / size[False]) + (urls.SEED_ODDS if w in seeds else 0)
    prior = math.log((docs[True] + 1) / (docs[False] + 1))
    return [(" ".join(t), prior + sum(map(odds, t + p[2]))) for t, p in zip(tokens, parsed, strict=True)]


GOOD = "<p>The rain in Spain stays mainly in the plain, and <b>the news</b> goes on &amp; on</p><script>casino()</script> free-bets.example.net"
ABUSIVE = "<p>What a stupid idiot, you worthless scum, the trash of the plain</p>"


def small_web():
    """Pages of which two hosts without a seed word have abusive texts."""
    rows = []
    for i in range(120):
        host = ["theplain.example.org", "newsrain.example.org", "rainmain.example.org", "blog.thenews.example.org"][i % 4]
        bad = host in ("rainmain.example.org",) and i % 8 != 7
        rows.append((i, f"https://{host}/en/{i}.html", ABUSIVE if bad else GOOD + " main rain"))
    rows += [(1000, "http://cheappills.example.org/x", GOOD), (1001, "http://mainrain.example.org/z", None), (1002, None, None), (None, "http://freecasinobonus.example.org", GOOD), (1003, "http://casinospain.example.org/", GOOD)]
    return rows + [(2**53 + 1, "http://theplain.example.org/", GOOD), (2**53 + 1, "http://theplain.example.org/", GOOD)]


def test_words_scores_and_verdicts_equal_brute_force(spark):
    rows = small_web()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: chat.F.lit(True) for c in ("words", "token", "odds", "evidence", "label")}).repartition(3)
    got = urls.judge(df, rules=()).collect()
    assert len(got) == len(rows) and sum(r["page_id"] == 2**53 + 1 for r in got) == 2
    key = lambda i: (i is None, i)
    for r, (i, want) in zip(sorted(got, key=lambda r: key(r["page_id"])), sorted(zip([x[0] for x in rows], brute(rows), strict=True), key=lambda x: key(x[0])), strict=True):
        assert r["page_id"] == i and r["words"] == want[0] and abs(r["score"] - want[1]) < 1e-6
        assert r["verdict"] == ("block" if want[1] > 0 else "allow")
    by = {r["page_id"]: r for r in got}
    assert by[None]["words"] == "free casino bonus example org" and by[1000]["words"] == "cheap pills example org"
    assert by[1003]["words"] == "casino spain example org" and by[0]["words"] == "the plain example org"
    # a host without a seed word is blocked for what its pages say, one of the same words elsewhere too
    assert by[2]["verdict"] == by[1001]["verdict"] == "block" and by[0]["verdict"] == by[1]["verdict"] == "allow"
    assert by[1000]["verdict"] == by[None]["verdict"] == "block"


def test_evidence_outweighs_seeds_and_may_be_given(spark):
    rows = [(i, f"http://{['freebooks', 'freerain'][i % 2]}.example.org/{i}", i % 2 == 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean").repartition(2)
    got = urls.judge(df, rules=(), evidence="bad", seeds=("free",), seed_odds=1.0).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 600 and all((r["verdict"] == "block") == r["evidence"] for r in held)


def test_judge(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, host string, html string")
    rows = urls.judge(pages).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        host, path, rule, verdict = WANT[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict is None or r["verdict"] == verdict
    assert urls.judge(pages.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://" + "thenews" * 2000 + ".org/" + "a/" * 5000)], "page_id long, url string")
    assert urls.judge(long).first()["words"] == "thenews" * 2000 + " org"


def test_split_is_the_cheapest():
    counts = {"the": 50, "rain": 5, "in": 60, "spain": 5, "there": 9, "a": 30}
    costs = {w: math.log(159 / n) for w, n in counts.items()}
    for label in ("therain", "inspain", "a", "theraininspain"):
        best = np.inf
        for cuts in itertools.product((0, 1), repeat=len(label) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(label)]
            best = min(best, sum(costs.get(label[x:y], 7.1 + 3 * (y - x)) for x, y in itertools.pairwise(at)))
        assert np.isclose(sum(costs[w] for w in urls.split_label(label, costs, 7.1)), best)
    assert urls.split_label("therain", costs, 7.1) == ["the", "rain"] and urls.split_label("", costs, 7.1) == [] and urls.split_label("xain", costs, 7.1) == ["xain"]


@pytest.fixture(scope="module")
def conversations(spark):
    rows = []
    for c in range(60):
        if c % 5 == 0:
            rows.append((c, 0, "system", "You help."))
        for t in range(1, 2 + 2 * (c % 4 + 1)):
            rows.append((c, t, "user" if t % 2 else "assistant", ["Where is it?", "Where is it?\nTell me."][(t + c) % 2 if t % 4 == 1 else 0] if t % 2 else ["It is there. " * 20 + "\nYes.\n\nMore of it.", "No."][(t // 2 + c) % 2]))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_roles_are_recovered(conversations):
    parts = chat.transcripts(conversations)
    got = chat.parse(parts.select("conv_id", "part", "text"), chat.fit_model(parts)).where("begins").collect()
    truth = {(r["conv_id"], r["part"]): r["role"] for r in parts.collect()}
    right = sum(truth[r["conv_id"], r["first_part"]] == r["role"] for r in got)
    assert right / len(got) > 0.95 and len(got) > 0.9 * len(truth)
    kept_out = [r for r in got if zlib.crc32(str(r["conv_id"]).encode()) % 5 == 0]
    assert kept_out and sum(truth[r["conv_id"], r["first_part"]] == r["role"] for r in kept_out) / len(kept_out) > 0.9
    assert all(r["text"].startswith(f"<|{r['role']}|>\n") and r["text"].endswith("\n<|end|>") for r in got)


def test_blocks_decode_like_the_whole(spark, conversations, monkeypatch):
    rng = np.random.default_rng(0)
    model = chat.fit_model(chat.transcripts(conversations))
    sym = rng.integers(0, chat.SYMBOLS, 200)
    whole = chat.viterbi(model, sym, None, None)
    cuts = [0, 1, 50, 51, 130, 200]
    blocks = [sym[a:b] for a, b in itertools.pairwise(cuts)]
    ends = chat.join_blocks([chat.transfer(model, b, k == 0) for k, b in enumerate(blocks)])
    got = np.concatenate([chat.viterbi(model, b, e, last) for b, (e, last) in zip(blocks, ends, strict=True)])

    def score(states):
        s = model.first[states[0]] + model.emit[states[0], sym[0]]
        return s + sum(model.step[a, b] + model.emit[b, x] for a, b, x in zip(states[:-1], states[1:], sym[1:], strict=True))

    assert np.isclose(score(whole), score(got))


def test_viterbi_is_the_best_of_all(conversations):
    model = chat.fit_model(chat.transcripts(conversations))
    rng = np.random.default_rng(4)
    for n in (1, 2, 4):
        sym = rng.integers(0, chat.SYMBOLS, n)

        def score(states, sym=sym):
            return model.first[states[0]] + sum(model.emit[s, x] for s, x in zip(states, sym, strict=True)) + sum(model.step[a, b] for a, b in itertools.pairwise(states))

        best = max(map(score, itertools.product(range(chat.STATES), repeat=n)))
        assert np.isclose(score(chat.viterbi(model, sym, None, None).tolist()), best)


def test_conversation_minus_one_and_rows_without_id(spark, conversations):
    model = chat.fit_model(chat.transcripts(conversations))
    rows = [(c, t, f"{['User', 'Assistant'][(t + (c is None)) % 2]}: x {t}") for c in (-1, 0, None) for t in range(200)]
    got = chat.parse(spark.createDataFrame(rows, "conv_id long, part long, text string"), model).collect()
    for c in (-1, 0, None):
        own = sorted((r["first_part"], r["role"]) for r in got if r["conv_id"] == c)
        assert own == [(t, ["user", "assistant"][(t + (c is None)) % 2]) for t in range(200)]


def test_one_long_conversation(spark, conversations, monkeypatch):
    monkeypatch.setattr(chat, "PARTS", 4)
    rows = [(1, t, ["user", "assistant"][t % 2], f"User: question {t}?" if t % 2 == 0 else f"Assistant: answer {t}.") for t in range(50)]
    parts = spark.createDataFrame(rows, "conv_id long, part long, role string, text string")
    got = chat.parse(parts, chat.fit_model(chat.transcripts(conversations))).collect()
    assert sorted((r["first_part"], r["role"]) for r in got) == [(t, r) for _, t, r, _ in rows]


def test_odd_rows(spark, conversations):
    model = chat.fit_model(chat.transcripts(conversations))
    rows = [(1, 0, None), (1, 1, ""), (1, 1, "x"), (None, 0, "User: hi"), (None, None, "Bot: yes"), (2, None, "a\n\n\nb"), (3, 5, "x " * 50_000), (4, 0, "same"), (4, 0, "same")]
    parts = spark.createDataFrame(rows, "conv_id long, part long, text string").withColumn("block", chat.F.lit("!"))
    got = chat.parse(parts, model).collect()
    assert {r["conv_id"] for r in got} == {1, 2, 3, 4, None}
    assert {r["role"] for r in got if r["conv_id"] is None} == {"user", "assistant"}
    assert chat.parse(parts.limit(0), model).count() == 0
    empty = chat.fit_model(parts.limit(0).withColumn("role", chat.F.lit("user")))
    assert np.isfinite(empty.emit).all()


def test_markers():
    for line, want in [("User: hi", ("user", "hi")), ("### Assistant", ("assistant", "")), ("<|system|> be", ("system", "be")), ("**Human:** yo", ("user", "yo")), ("[AI] x", ("assistant", "x")), ("plain words: no", ("none", "plain words: no")), ("Bob: hey", ("named", "Bob: hey"))]:
        kind, text, _ = chat.read_line(line)
        assert (chat.MARKERS[kind], text) == want

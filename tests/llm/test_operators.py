"""Operators against brute force on small fixtures: nulls, empty and long texts, ties,
repeated rows, empty tables, and extra columns whose names clash."""

import base64
import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, langid, mincut, minhash, packing, pii, topk, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ref string, row string, start int, key int"


def documents(spark, texts, langs=None, ids=None):
    """A documents table with columns that operators use as names themselves."""
    rows = [((ids or range(len(texts)))[i], t, (langs or {}).get(i), "s", 0, "r", "w", 7, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, v=400):
    return " ".join(f"w{rng.randrange(v)}x" for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    long = words(rng, 30_000, 5000)
    return [None, "", " \n\t ", "one", "two words", "ab" * 3000, long, long, "é à ü — 你好 <|endoftext|>", "Ⅷ ² J̌ İΣ don't I'LL", "a  b \n c d", "x" * 5000, "trail ", " lead"]


# Near-duplicates


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(rng):
    out = []
    for _ in range(12):
        base = words(rng, 120).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    passage = words(rng, 60)
    out += [passage + " " + words(rng, 40, 10**6) for _ in range(20)]  # a passage many share
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, odd_texts, k, percent):
    texts = near_copies(random.Random(k)) + odd_texts
    got = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, texts), k, percent).collect()}
    want = brute_components(texts, k, percent)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (w[1] == i) for i, w in enumerate(want))


def test_near_duplicates_chain_through_one_bucket(spark):
    """Links that no leader has: a chain of copies, each one edit further from the first."""
    base = [f"t{i}" for i in range(100)]
    texts = []
    for i in range(0, 60, 3):
        base[i] = f"new{i}"
        texts.append(" ".join(base))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, texts), 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == [w[1] for w in brute_components(texts, 3, 85)]


def test_near_duplicates_null_and_repeated_ids(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "z", None], ids=[5, None, 3, 5, None])
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(docs, 3, 85).collect())
    assert rows == sorted([(False, 5, 3, False), (True, 0, 3, False), (False, 3, 3, True), (False, 5, 5, True), (True, 0, -1, False)])
    assert sorted(str(r["text"]) for r in minhash.keep_one(docs).collect()) == ["None", "a b c d e f", "z"]
    assert minhash.near_duplicates(docs.limit(0), 3, 85).count() == 0


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_brute_force(spark, odd_texts):
    rng = random.Random(1)
    parts = ["a@b.c_d@e.f", "x.y@z-1.co.uk.", "1.2.3.4.5.6.7.8", "001.0255.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "+1((((", "é", "@", "1" * 30, "++49 170 1234567", "%+@-.-"]
    texts = ["".join(rng.choice(parts + [" ", "\n", "0", "."]) for _ in range(rng.randrange(12))) for _ in range(400)] + odd_texts + ["1" * 50_000, "a." * 20_000 + "@", "1 " * 20_000]
    got = {r["doc_id"]: r for r in pii.annotate(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        s = brute_spans(t)
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), t[:80]
        n = Counter(k for *_, k in s)
        assert [got[i][f"n_{k}"] for k in BASE] == [n[k] for k in BASE]


def test_bootstrap_finds_unseen_identifiers(spark):
    seeds = [f"please write my phone: +1 555 010 {1000 + i}" for i in range(6)]
    docs = documents(spark, [*seeds, "and write my phone: 555-010-7777.", "room number 555-010-7777", "nothing here"])
    got = {r["doc_id"]: r["spans"] for r in pii.annotate(docs).collect()}
    assert got[6] == "phone:20:32" and got[7] == "" and got[8] == ""
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert out[6]["text"] == "and write my phone: <PHONE>." and out[8]["text"] == "nothing here" and out[6]["row"] == "w"
    assert pii.annotate(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_bootstrap_finds_identifiers_with_blanks(spark):
    seeds = [f"please write my phone: +1 (980) 555-{1000 + i} today" for i in range(30)] + [f"the card number {c} paid" for c in ("4111 1111 1111 1111", "5555 5555 5555 4444", "4012 8888 8888 1881", "4222-2222-2222-2", "6011 1111 1111 1117", "3566 0020 2036 0505", "5105 1051 0510 5100")]
    unseen = {"write my phone: (980) 555-6268 today": "(980) 555-6268", "write my phone: 555 123 4567.": "555 123 4567", "phone: (212) 555-0101": "(212) 555-0101", "(213) 555-0102 today": "(213) 555-0102", "my phone: 555 123 4568 1.2.3.4": "555 123 4568", "that card number 4111 1111 1111 1112 paid": "4111 1111 1111 1112"}
    docs = documents(spark, [*seeds, *unseen, "in room 12 3456 789 0", "12 34"])
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for i, (text, one) in enumerate(unseen.items(), len(seeds)):
        kind = "<CARD>" if "card" in text else "<PHONE>"
        assert out[i] == text.replace(one, kind).replace("1.2.3.4", "<IP>"), out[i]
    assert out[len(seeds) + 6] == "in room 12 3456 789 0" and out[len(seeds) + 7] == "12 34"


def test_contexts_reach_over_long_words_and_other_numbers(spark):
    long = "w" * 300
    seeds = [f"see {long} {long}: +1 555 010 {1000 + i}" for i in range(6)]
    docs = documents(spark, [*seeds, f"and {long} {long}: 555-010-7777", f"{long} other: 555-010-7777"])
    got = {r["doc_id"]: r["spans"] for r in pii.annotate(docs).collect()}
    assert got[6] == f"phone:{4 + 300 + 1 + 302}:{4 + 300 + 1 + 302 + 12}" and got[7] == ""
    words = spark.createDataFrame([("a 1 bb 22, c@d.e (3) f 4",)], "t string").select(F.explode(pii.matches(F.col("t"), pii.TOKEN, context=True)).alias("x")).select("x.*").collect()
    assert [(r["m"], r["before"], r["after"]) for r in words] == [("1", "a ", " bb"), ("22,", "1 bb ", " c@d.e"), ("c@d.e", "bb 22, ", " (3)"), ("(3)", "22, c@d.e ", " f"), ("4", "(3) f ", "")]


def test_texts_of_very_many_numbers(spark):
    """Work grows with the text: 20,000 separate addresses and as many other numbers."""
    text = " ".join(f"{i % 256}.0.{i // 256 % 256}.7 n{i}" for i in range(20_000))
    docs = documents(spark, [text, "1 " * 20_000, None])
    got = {r["doc_id"]: r for r in pii.annotate(docs).collect()}
    assert got[0]["n_ip"] == 20_000 and got[0]["base_sha256"] == hashlib.sha256(",".join(f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"\b[0-9]+(\.[0-9]+){3}", text)).encode()).hexdigest()
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[0] == " ".join(f"<IP> n{i}" for i in range(20_000)) and out[1] == "1 " * 20_000 and out[2] is None


def test_redaction_equals_plain_replacement(spark):
    rng = random.Random(14)
    parts = ["a@b.cd", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "é", " and ", "\n", "word ", "x" * 1500]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(60)]
    docs = documents(spark, texts)
    spans = {r["doc_id"]: r["spans"] for r in pii.annotate(docs).collect()}
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for i, text in enumerate(texts):
        at, want = 0, ""
        for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans[i].split(",") if x)), key=lambda x: (x[1], pii.KINDS.index(x[0]))):
            if a >= at:
                want += text[at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        assert out[i] == want + text[at:]


def test_bootstrap_equals_plain_scoring(spark):
    """The rounds of pattern and instance scores against a plain loop over one graph."""
    from quillspark.llm.common import Scratch

    rng = random.Random(15)
    rows = [(f"p{rng.randrange(12)}", f"i{rng.randrange(40)}", rng.choice(["phone", "card"])) for _ in range(600)]
    seeds = {(k, i): rng.random() < 0.7 for _, i, k in rows}
    edges = {(k, p, i) for p, i, k in rows}
    trust = {x: float(v) for x, v in seeds.items()}
    for _ in range(pii.ROUNDS):
        conf = {}
        for k, p in {(k, p) for k, p, _ in edges}:
            t = [trust[k, i] for k2, p2, i in edges if (k2, p2) == (k, p)]
            if sum(x >= 0.5 for x in t) >= pii.SUPPORT and sum(t) / len(t) >= pii.CONFIDENCE:
                conf[k, p] = sum(t) / len(t)
        for x in trust:
            doubt = 1.0
            for k, p, i in edges:
                if (k, i) == x and (k, p) in conf:
                    doubt *= max(1 - conf[k, p], 1e-6)
            trust[x] = max(float(seeds[x]), 1 - doubt)
    df = spark.createDataFrame([(p, i, k, seeds[k, i]) for p, i, k in rows], "pattern string, instance string, kind string, seed boolean")
    got = {(r["kind"], r["pattern"]): round(r["conf"], 9) for r in pii.bootstrap(df, Scratch(spark, "test")).collect()}
    assert got == {x: round(c, 9) for x, c in conf.items()} and got


# Toxicity


def test_restores_disguised_words(spark):
    rng = random.Random(2)
    vocabulary = "the idiot was here and some moron said that his stupid house is like a garden with trees".split()
    docs = documents(spark, [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(200)])
    channel = toxicity.Channel(toxicity.log_model(toxicity.count_trigrams(docs)))
    assert "idiot" in channel.words("what an 1d10t he is")
    assert "idiot" in channel.words("an i d i o t again")
    assert "idiot" in channel.words("an i.d.i.o.t again")
    assert "stupid" in channel.words("so stuuuupid")
    assert channel.restore("plain") == "plain" and channel.words("2024 is 100") == {"2024", "is", "100"}


def test_restores_other_disguises(spark):
    rng = random.Random(2)
    vocabulary = "the idiot was here and some moron said that his stupid house is worthless like a loser with a class of scum at the pass all summer".split()
    docs = documents(spark, [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(200)])
    channel = toxicity.Channel(toxicity.log_model(toxicity.count_trigrams(docs)))
    forms = {"idiot": ["id-iot", "i..d..i..o..t", "!diot", "i  d  i  o  t", "i\td\ti\to\tt", "i\nd\ni\no\nt", "1 d 1 0 t", "i - d - i - o - t", "i,d,i,o,t", "i***d***i***o***t", "iddiot"], "stupid": ["stuupid", "s-tupid"], "loser": ["losser", "l00000ser"], "scum": ["sc|_|m"], "worthless": ["worthle$$", "w()rthle$$"], "pass": ["pa55", "p@$$"]}
    for word, ways in forms.items():
        for way in ways:
            assert word in channel.words(f"what an {way} said"), way
    for word in vocabulary:
        assert channel.words(f"{word}! ({word}, {word}.)") == {word}, word
    assert channel.words("moron/loser said: 'here', 10 20 30 +1 $5") == {"moron", "loser", "said", "here", "10", "20", "30", "1", "5"}
    for word in ["".join(rng.choice("abils") * rng.choice([1, 1, 2]) for _ in range(6)) for _ in range(300)]:
        if not toxicity._REPEATED.search(word):
            assert channel.undouble(word) == channel.decode(channel.lattice(word))


def test_scores(spark, odd_texts):
    rng = random.Random(4)
    bad = {i: i % 3 == 0 for i in range(300)}
    texts = [words(rng, 20, 50) + (" scumbag" if bad[i] else "") for i in range(300)] + odd_texts
    labels = spark.createDataFrame([(i, None, int(v)) for i, v in bad.items()] + [(0, None, 0), (7, None, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark, texts)
    learned = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, learned).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert sum(got[i]["predicted"] == v for i, v in bad.items()) > 295
    assert {r["doc_id"] for r in toxicity.keep_clean(docs, learned).collect()} == {i for i, r in got.items() if not r["predicted"]}
    nothing = toxicity.learn(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), learned).count() == 0


# Packing


def brute_bins(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        room.append(capacity - n) if not fits else room.__setitem__(room.index(min(fits)), min(fits) - n)
    return len(room)


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(60):
        cap = rng.choice([7, 16, 100])
        lengths = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(0, 200))]
        runs = packing.plan(Counter(lengths), cap)
        used = {}
        for n, total in Counter(lengths).items():
            own = runs[runs[:, 0] == n]
            for rank in range(total):
                r = own[np.searchsorted(own[:, 1], rank, "right") - 1]
                k = rank - r[1]
                used.setdefault(r[2] + k // r[3], []).append((r[4] + k % r[3] * n, n))
        assert len(used) == brute_bins(lengths, cap)
        for parts in used.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= cap


def test_packing_equals_tokenizers(spark, odd_texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [*odd_texts, "x <|endoftext|> y", "<|startoftext|>A b<|endoftext|>c", "<|ENDOFTEXT|> <|endoftext |>", "é<|endoftext|>é " * 3000]
    rows = packing.pack(documents(spark, texts), path).collect()
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == [(a, min(4096, len(ids) - a)) for a in range(0, len(ids), 4096)]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    assert packing.pack(documents(spark, odd_texts).limit(0), path).count() == 0


def test_words_and_their_parts_share_a_memo(monkeypatch):
    """A part is remembered as the word it may be, and a memo that starts anew gives equal ids."""
    words = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    texts = ["alpha, beta. Gamma;7 ", "alpha beta  gamma", "ALPHA's été,\nété Ω, Ωx ... a1b2", "", "beta... Alpha, Ω"]
    plain = [np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.encode_batch(texts) == plain and {"alpha", ",", "beta", "gamma", "été"} <= set(words.words)
    monkeypatch.setattr(packing, "MEMO", 3)
    assert [words.encode_batch([t])[0] for t in texts] == plain


# Language


def test_languages(spark, odd_texts):
    rng = random.Random(6)
    made = {"xx": "ab ac ad ba ca".split(), "yy": "zo zu oz uz zz".split()}
    texts, langs = [], {}
    for i in range(200):
        langs[i] = "xx" if i % 2 else "yy"
        texts.append(" ".join(rng.choice(made[langs[i]]) + rng.choice(made[langs[i]]) for _ in range(30)))
    docs = documents(spark, texts + odd_texts, langs)
    model = langid.learn(docs.where("doc_id < 100"))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == langs[i] for i in range(100, 200))
    assert [got[200 + i]["lang_pred"] for i in range(3)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.predict(docs, langid.learn(docs.limit(0))).collect()} == {"und"}
    kept = {r["doc_id"] for r in langid.keep_known(docs, model).collect()}
    assert set(range(200)) <= kept and not {200, 201, 202} & kept


def plain_grams(text):
    """N-grams of one to three letters word by word, edges marked by a blank."""
    n = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        n.update(word)
        n.update(a + b for a, b in zip(" " + word, word + " "))
        n.update(a + b + c for a, b, c in zip(" " + word, word, word[1:] + " "))
    return n


def as_text(key):
    return "".join(chr(key >> 21 * i & 0x1FFFFF) for i in (2, 1, 0) if key >> 21 * i & 0x1FFFFF)


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 50, 1 << 16])
def test_grams_equal_plain_count_at_any_stretch(odd_texts, stretch):
    for text in [*[t or "" for t in odd_texts if stretch > 3 or len(t or "") < 7000], "ab  cd", "a", " a", "a ", "ΑΣ ΣΑ", "x" * 300 + "1" + "yz" * 90]:
        assert {as_text(k): n for k, n in zip(*langid.grams(text, stretch))} == plain_grams(text)


def test_predictions_equal_plain_out_of_place_distance(spark, odd_texts):
    rng = random.Random(16)
    made = {"xx": "abc", "yy": "bcd", "zz": "xyz"}
    langs = {i: list(made)[i % 3] for i in range(90)}
    texts = [" ".join("".join(rng.choice(made[langs[i]]) for _ in range(rng.randrange(1, 6))) for _ in range(40)) for i in range(90)] + odd_texts
    docs = documents(spark, texts, langs)
    order = lambda counts, top: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], [0] * (3 - len(x[0])) + [ord(c) for c in x[0]]))][:top]
    profiles = {lang: order(plain_grams(" ".join(t for i, t in enumerate(texts) if langs.get(i) == lang)), langid.PROFILE) for lang in made}
    for r in langid.predict(docs, langid.learn(docs)).collect():
        own = order(plain_grams(texts[r["doc_id"]]), langid.TOP)
        far = {lang: sum(min(abs(p.index(g) - i), langid.PROFILE) if g in p else langid.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        want = (best, 1 - far[best] / (langid.PROFILE * len(own))) if own else ("und", 0.0)
        assert (r["lang_pred"], round(r["score"], 12)) == (want[0], round(want[1], 12))


# Byte pairs


def test_encoding_equals_tiktoken(spark, odd_texts):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    texts = odd_texts + ["".join(rng.choice("ab ") for _ in range(60)) for _ in range(200)] + ["".join(rng.choice("the an\n'è!1　") for _ in range(200)) for _ in range(200)] + ["a" * 3000, "=-" * 700]
    got = {r["doc_id"]: r for r in bpe.encode_documents(documents(spark, texts), path, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == enc.encode_ordinary(t or "")
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(documents(spark, texts).limit(0), path, P.PATTERN).count() == 0


# Vectors

EMBEDDINGS = "vec_id long, embedding array<float>, label int, v int, cls string"


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.RandomState(8)
    base = rng.randn(12, 16)
    x = [(base[i % 12] + rng.randn(16) * rng.choice([0.02, 0.2, 0.4])).tolist() for i in range(400)]
    x[5] = x[17] = x[29]
    rows = [(i, v, i % 12 % 3, 1, "c") for i, v in enumerate(x)]
    rows += [(400, None, 0, 1, "c"), (401, [], 0, 1, "c"), (402, [0.0] * 16, 0, 1, "c"), (403, [float("nan")] * 16, 0, 1, "c"), (404, x[0], None, 1, "c"), (405, [None] + x[0][1:], 0, 1, "c"), (406, x[0], 0, 1, "c")]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, EMBEDDINGS)).collect()}
    m = np.array([*x, *[[0.0] * 16] * 6, x[0]], np.float32).astype(float)
    m[406] = np.array(x[0], np.float32)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    lab = np.array([r[2] if r[2] is not None else -1 for r in rows])
    link = (unit @ unit.T >= 0.93) & (lab[:, None] == lab[None]) & (lab[:, None] >= 0)
    np.fill_diagonal(link, False)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.99 * link.sum() and all(got[i]["n_links"] <= link[i].sum() for i in range(407))
    assert all(got[i]["component_id"] == i and got[i]["n_links"] == 0 and got[i]["kept"] for i in range(400, 406))
    assert vectors.near_vectors(spark.createDataFrame([], EMBEDDINGS)).count() == 0


def test_near_vectors_lose_no_link_among_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 5)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "ROWS", 8)
    rng = np.random.RandomState(11)
    base = rng.randn(250, 12)
    x = np.concatenate([base, base + rng.randn(250, 12) * 0.38, base[:100] + rng.randn(100, 12) * 0.3]).astype(np.float32).astype(float)
    label = np.arange(len(x)) % 250 % 2
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame([(i, v.tolist(), int(label[i]), 1, "c") for i, v in enumerate(x)], EMBEDDINGS)).collect()}
    u = vectors.unit(x)
    link = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    assert link.sum() > 100 and [got[i]["n_links"] for i in range(len(x))] == link.sum(axis=1).tolist()
    least = np.arange(len(x))
    for _ in range(len(x)):
        least = np.array([min(least[i], *least[link[i]]) if link[i].any() else least[i] for i in range(len(x))])
        if not (least[np.nonzero(link)[0]] != least[np.nonzero(link)[1]]).any():
            break
    assert [got[i]["component_id"] for i in range(len(x))] == least.tolist()


def test_near_vectors_of_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 10)
    rng = np.random.RandomState(17)
    x = [rng.randn(8).tolist() for _ in range(60)] + [[1.0, 2.0], [2.0, 4.1], [2.0, -1.0], [1.0, 2.0, 0.0], [3.0, 6.0, 0.1], [1.0, 2.0]]
    labels = [i % 2 for i in range(60)] + [0, 0, 0, 0, 0, 1]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame([(i, v, k, 1, "c") for i, (v, k) in enumerate(zip(x, labels))], EMBEDDINGS)).collect()}
    assert [got[i] for i in range(60, 66)] == [(1, 60), (1, 60), (0, 62), (1, 63), (1, 63), (0, 65)]


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_equals_brute_force(spark, scale):
    rng = np.random.RandomState(9)
    x = np.round(rng.randn(300, 8), 1) * scale
    rows = [(i, v.tolist(), 0, 1, "c") for i, v in enumerate(x)] + [(300, None, 0, 1, "c"), (320, [float("inf")] * 8, 0, 1, "c"), (340, [None] * 8, 0, 1, "c")]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v int, cls string"), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    m = [[int(np.floor(64 * c)) for c in v] for v in x]
    assert set(got) == set(range(0, 300, 20))
    for q in got:
        s = sorted((-sum(a * b for a, b in zip(m[q], m[i])), i) for i in range(300) if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -v) for k, (v, i) in enumerate(s)]


def brute_top(x, ids, q, k=20):
    s = sorted((-sum(int(a) * int(b) for a, b in zip(x[q], x[i])), ids[i]) for i in range(len(x)) if ids[i] != ids[q])[:k]
    return [(v, -n) for n, v in s]


def test_top_k_stops_on_proof():
    """Few great components decide: segments of lesser impact are never processed."""
    rng = np.random.RandomState(12)
    x = rng.randint(-1, 2, (3000, 40))
    for i in range(3000):
        x[i, rng.choice(40, 6, replace=False)] = rng.randint(2000, 6400, 6) * rng.choice([-1, 1], 6)
    ids, said, got = np.arange(3000), {}, {}
    index = topk.Index(x)
    assert list(index.segments) == sorted(index.segments, reverse=True) and sum(index.postings.values()) == np.count_nonzero(x)
    for r, c, score in topk.best_of_index(x[:60], ids[:60], index, ids, 20, said):
        for a, b, n in zip(r, c, score):
            got.setdefault(a, []).append((b, n))
    assert all(got[q] == brute_top(x, ids, q) for q in range(60))
    assert said["done"] < 0.6 * said["all"]


def test_top_k_of_odd_vectors(spark, monkeypatch):
    """Repeated ids and rows, zeros, unequal and great widths, several blocks and query batches."""
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "INDEX", 20)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.RandomState(13)
    x = [np.round(rng.randn(rng.choice([1, 3, 9])), 1) for _ in range(250)] + [np.zeros(4)] * 30 + [np.ones(3)] * 60 + [np.round(rng.randn(6000), 1)] * 2
    ids = [*range(340), 340, 340]
    schema = "vec_id long, embedding array<double>, label int, xb int, side int"
    rows = [(i, v.tolist(), 0, 1, 2) for i, v in zip(ids, x)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    m = np.zeros((len(x), 6000), int)
    for i, v in enumerate(x):
        m[i, : len(v)] = np.floor(64 * v)
    for q in range(0, 340, 20):
        assert sorted(got[q]) == [(i + 1, *t) for i, t in enumerate(brute_top(m, ids, q, 5))]
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0


# Chats and pages


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <|endoftext|> nice"), (1, 1, "user", None), (1, 2, "assistant", "a\\b <| é你 \\| <\\|"), (1, 2, "assistant", ""), (1, 3, None, "x"), (2, 0, "assistant", " lead \n"), (2, 1, "assistant", "next"), (None, 0, "user", "hi"), (None, 0, "user", "hi")]
    path = P.path("byte_bpe_50k.json")
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("x")), path)
    turns = {r["conv_id"]: chat.read_turns(r["formatted"]) for r in made.collect()}
    assert turns[1] == [("system", "be <|endoftext|> nice"), ("user", ""), ("assistant", ""), ("assistant", "a\\b <| é你 \\| <\\|"), ("", "x")]
    assert turns[None] == [("user", "hi")] * 2
    got = {r["conv_id"]: r for r in chat.read_back(made, path).collect()}
    loss = "a\\b <| é你 \\| <\\|"
    assert got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[1]["loss_chars"] == len(loss)
    assert got[2]["loss_sha256"] == hashlib.sha256(b" lead \nnext").hexdigest() and got[None]["loss_chars"] == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), path).count() == 0


def test_min_cut_equals_brute_force():
    rng = random.Random(10)
    for _ in range(200):
        n = rng.randrange(1, 8)
        s, t = [rng.random() for _ in range(n)], [rng.random() for _ in range(n)]
        edges = [(a, b, rng.random() / 2) for a in range(n) for b in range(a) if rng.random() < 0.4]

        def cost(side):
            return sum(t[i] if side[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(mincut.min_cut(s, t, edges)) - best) < 1e-6


PAGE = """<!DOCTYPE html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><header><a href=/>Site</a></header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies to do things, a long sentence.</p></div>
<article><h1>Title &amp;amp;</h1><p>First <b>bold</b>&nbsp;text, 3 < 4<br>and on<p>Second.<aside>Elsewhere</aside><form><label>Mail</label></form>
<div class="ad">Buy</div><section id="comments"><p>I liked this article, said a reader at length.</p></section></article><footer>&copy; me</footer>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "just words"), (5, "u", "<p>unclosed <b>tag and < sign"), (6, "u", "<div" * 2000)]
    got = {r["page_id"]: r for r in mincut.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[1]["text"] == "Title &amp;\nFirst bold text, 3 < 4 and on\nSecond."
    assert [got[i]["text"] for i in (2, 3)] == ["", ""] and got[4]["text"] == "just words" and html.unescape(got[5]["text"]) == "unclosed tag and < sign"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


LONG = "A sentence of the article itself, with some words in it, tells what there is to tell. " * 3


def test_the_cut_corrects_misjudged_blocks():
    page = f"<nav><a href=1>One</a></nav><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p><a href=x>Short one</a></p><p>{LONG}a</p><p>{LONG}</p><p>Hm</p></article><footer>me</footer>"
    found, z, keep = mincut.labelled(page)
    assert [x > 0 for x in z] == [False, True, True, True, False, True, True, False, False]
    assert keep == [False, True, True, True, True, True, True, True, False]
    page = f"<div><div><a href=1>One</a></div><div><a href=2>Two</a></div><div>Three, in some words</div><div><a href=4>Four</a></div></div><section><h1>Title</h1><p>{LONG}</p><p>{LONG}b</p></section>"
    found, z, keep = mincut.labelled(page)
    assert keep == [False] * 4 + [True] * 3 and mincut.main_text(page).startswith("Title")


def test_labels_are_the_cheapest_of_all():
    """Brute force over every labelling of small pages made at random."""
    rng = random.Random(21)
    parts = ["<p>%s</p>", "<div class=ad>%s</div>", "<li><a href=1>%s</a></li>", "<div>%s</div>", "<h2>%s</h2>", "<aside>%s</aside>", "<section class=post><p>%s</p></section>"]
    changed = 0
    for _ in range(150):
        page = "".join(rng.choice(parts) % " ".join("word" for _ in range(rng.choice([1, 3, 60]))) for _ in range(rng.randrange(1, 9)))
        page = rng.choice(["<article>%s</article>", "<div>%s</div>", "<main><div>%s</div></main>"]) % page + "<footer>end</footer>"
        found, parent, depth = mincut.blocks(page)
        mincut.settle(found)
        z, edges = mincut.costs(found), mincut.neighbours(found, parent, depth)

        def cost(side):
            return sum(max(0.0, -x) if k else max(0.0, x) for x, k in zip(z, side)) + sum(c for a, b, c in edges if side[a] != side[b])

        _, _, keep = mincut.labelled(page)
        best = min(cost([bool(m >> i & 1) for i in range(len(found))]) for m in range(1 << len(found)))
        assert abs(cost(keep) - best) < 1e-2
        changed += keep != [x > 0 for x in z]
    assert changed > 5


def test_text_of_plain_pages_equals_their_articles(spark):
    """The tables' pages hold one article each, which an expression finds as well."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in mincut.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)
        if inner:
            parts = re.split(r"</?(?:p|h1|ul|li|div|blockquote|h2)>", re.sub(r"<br>", " ", inner[1]))
            want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
            assert got[r["page_id"]] == "\n".join(x for x in want if x)


@pytest.mark.parametrize("part", ["<div class='ad'>%s</div>", "<p class='advert'>%s</p>", "<aside><p>%s</p><p>%s</p></aside>", "<section class='newsletter'><h3>Join</h3><p>%s</p></section>", "<form><p>%s</p><button>Go</button></form>", "<p hidden>%s</p>", "<div id='comments'><div class='comment'><p>%s</p></div><div class='comment'><p>%s</p></div></div>", "<ul class='social-share'><li><a>tw</a></li></ul>", "<div class='notice'>%s</div>", "<nav><a>%s</a></nav>"])
def test_parts_of_an_article_that_are_none_of_it(part):
    part = part.replace("%s", LONG)
    for page in (f"<article><h1>Title</h1><p>{LONG}</p>{part}<p>Short.</p><p>{LONG}</p></article>", f"{part}<article><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></article>", f"<div class='content'><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>{part}"):
        assert mincut.main_text(page) == f"Title\n{LONG.strip()}\nShort.\n{LONG.strip()}"


def test_very_long_and_empty_pages(spark):
    rows = [(1, "u", "<article>" + "<p>Some words of it.</p>" * 20_000 + "</article>"), (2, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (3, "u", "<article><p>" + "x" * 500_000 + "</p></article>"), (3, "u", "<p>same</p>"), (3, "u", "<p>same</p>")]
    schema = "page_id long, url string, html string"
    got = [r for r in mincut.extract(spark.createDataFrame(rows, schema).withColumns({"text": F.lit("t"), "n_chars": F.lit(1)})).collect()]
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r["text"])
    assert len(by[1][0].split("\n")) == 20_000 and by[2] == ["deep"] and sorted(map(len, by[3])) == [4, 4, 500_000]
    assert mincut.extract(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("around", ['<body class="single has-sidebar">%s</body>', '<html class="nav-open"><body class="no-sidebar with-comments">%s</body></html>', '<main class="has-sidebar">%s</main>', '<div class="layout has-sidebar"><div class="with-comments">%s</div></div>'])
@pytest.mark.parametrize("article", ["<article>", '<article class="post category-legal tag-search">', '<article class="share">', '<main class="with-comments">'])
def test_names_around_an_article_lose_nothing(around, article):
    page = around % ("<nav><a href=1>One</a></nav>" + article + "<h1>Title</h1><p>First text, of some length.</p><p>Second.</p></" + article[1:].split()[0].strip(">") + "><footer>me</footer>")
    assert mincut.main_text(page) == "Title\nFirst text, of some length.\nSecond."


def test_comments_in_articles_are_left_out():
    said = "<p>I liked this article, said a reader at length.</p></article>"
    page = '<main><article class="post"><h1>Title</h1><p>First text, of some length.</p></article><article class="comment">' + said + '<section id="comments"><article>' + said + "</section></main>"
    assert mincut.main_text(page) == "Title\nFirst text, of some length."
    page = '<main><h1>Title</h1><p>First text, of some length.</p></main><div class="related"><article><p>Another story, told in some words.</p></article></div>'
    assert mincut.main_text(page) == "Title\nFirst text, of some length."

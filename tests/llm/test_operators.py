"""Each operator against plain Python, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from corpusloom.llm import chat, decontam, jaccard, langid, pieces, pii, quality, rules, sharding, tokencount  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, matches string"
PROSE = "The quick brown fox jumps over the lazy dog near a river bank while children watch and clap their hands in joy today. "
ODD = [None, "", " ", "\n\n", "word", "Ünïcode — 日本語 𝄞 <|im_start|> %25", "x" * 5000, "a b " * 3000, PROSE * 40, "tab\there\x0bvt\x0cff\rcr", "<|endoftext|> it's 12 <|startoftext|>", "1 2 3\n1 2 3\n1 2 3"]


def table(spark, texts, source="s"):
    rows = [(k, t, "en" if k % 2 else None, source, None, "clash", "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, the last row twice, and a row without an id."""
    df = table(spark, ODD)
    return df.unionByName(df.where(f"doc_id = {len(ODD) - 1}")).unionByName(df.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))


def empty(odd):
    return odd.where("false")


# sharding --------------------------------------------------------------------------------------------------------------


def test_sharding_law_and_slots(spark, odd):
    many = odd.unionByName(table(spark, ["t"] * 3000).withColumn("doc_id", F.col("doc_id") + 100))
    found = sharding.assign(many, sharding.topology(40), sharding.topology(41), buckets=8).collect()
    assert len(found) == many.count()
    assert {r["grown_shard"] for r in found if r["grown_shard"] != r["shard"]} == {40}
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = dict(enumerate(ODD))
    for r in found:
        if r["doc_id"] is not None and r["doc_id"] < 100:
            data = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    assert sharding.assign(empty(odd), sharding.topology(40)).count() == 0


def test_sharding_follows_weights_and_moves_only_where_they_change(spark):
    docs = spark.range(20000).withColumnRenamed("id", "doc_id")
    old = [sharding.Shard("a", "k", 0, 1.0), sharding.Shard("a", "l", 1, 3.0), sharding.Shard("b", "k", 2, 4.0)]
    new = [*old, sharding.Shard("a", "k", 0, 2.0, generation=1)]
    both = sharding.with_shard(sharding.with_shard(docs, old), new).toDF("doc_id", "before", "after")
    counts = {r["before"]: r["count"] for r in both.groupBy("before").count().collect()}
    assert abs(counts[0] / 20000 - 1 / 8) < 0.02 and abs(counts[2] / 20000 - 1 / 2) < 0.02
    assert {r["after"] for r in both.where("before <> after").collect()} == {0}
    with pytest.raises(ValueError):
        sharding.tree([sharding.Shard("a", "k", 0, 0.0)])


# chats -----------------------------------------------------------------------------------------------------------------

LOG = "conv_id long, seq long, op string, target long, role string, text string"


def test_events_fold_into_messages(spark):
    log = [
        (1, 0, "delta", None, None, "before any message"),
        (1, 1, "message", None, "user", "hi"),
        (1, 2, "message", None, "assistant", ""),
        (1, 3, "delta", None, None, "he"),
        (1, 4, "delta", None, None, None),
        (1, 5, "delta", None, None, "llo"),
        (1, 6, "edit", 0, None, "hi there"),
        (1, 7, "message", None, "user", "more"),
        (1, 8, "regenerate", 1, None, "again"),
        (1, 9, "delta", 1, None, "!"),
        (1, 10, "unknown", 0, None, "x"),
        (1, 11, "edit", 9, None, "no such message"),
        (1, 12, "message", None, "user", "bye"),
        (None, 1, "message", None, None, None),
    ]
    found = chat.messages_of(spark.createDataFrame(log, LOG)).collect()
    assert sorted((r["conv_id"] or 0, r["message"], r["role"], r["text"]) for r in found) == [(0, 0, "", ""), (1, 0, "user", "hi there"), (1, 1, "assistant", "again!"), (1, 3, "user", "bye")]
    assert chat.format_chats(spark.createDataFrame([], LOG)).count() == 0


def test_chats_read_back_whatever_they_say(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "%3C|%25%0A", "a\nb<", "", None, "%", "<|", "<<||"]
    rows = [(c, t, ("user", "assistant", "we\nird<|", None)[(c + t) % 4], nasty[(c * 3 + t) % 8]) for c in range(4) for t in range(8)]
    rows += rows[:1]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.digest(chat.format_chats(chat.events_of(df))).collect():
        own = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]), key=lambda x: x)
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# quality rules ---------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rule_figures(text):
    w = WORD.findall(text)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    inside = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


def test_rule_figures(odd):
    found = rules.judge(odd).collect()
    assert len(found) == len(ODD) + 2
    for r in found:
        text = ODD[4 if r["doc_id"] is None else r["doc_id"]] or ""
        figures = rule_figures(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == figures
        assert r["base_failed"] == (figures[0] < 20 or 100 * figures[4] > 30 * figures[0])
        assert not (r["base_failed"] and r["kept"])
    assert rules.judge(empty(odd)).count() == 0


def test_frequent_lines_deplete_documents_of_their_host(spark):
    letters = "abcdefghij"
    name = lambda k: letters[k // 10] + letters[k % 10]
    own = [" ".join(f"{name(k)}x{name(j)}" for j in range(30)) for k in range(60)]
    boiler = "Menu  home about 12\n" + " ".join(f"b{name(j)}" for j in range(60))
    texts = [f"{boiler}\n{t}" if k < 40 else t for k, t in enumerate(own)]
    texts[0] = boiler
    found = {r["doc_id"]: r for r in rules.judge(table(spark, texts)).collect()}
    assert not found[0]["kept"] and found[50]["kept"] and found[1]["n_removed_words"] == 64
    assert all(found[k]["kept"] for k in range(1, 60))
    other = table(spark, texts).withColumn("source", F.col("doc_id").cast("string"))
    assert all(r["kept"] for r in rules.judge(other).collect())


def test_repeated_rows_lose_their_own_lines(spark):
    """Against brute force: rows of one doc_id, of none, and equal rows are judged alone, and count as one document."""
    import random

    draw = random.Random(9)
    pool = [" ".join(f"l{k}w{j}" for j in range(1 + k % 4)) for k in range(12)]
    rows = [(k, "\n".join(draw.choice(pool) for _ in range(draw.randint(0, 6))) + f"\nown {k} of 7", draw.choice(["a", "b", None])) for k in range(60)]
    rows = [*rows, *rows[:5], *rows[:5], *[(None, t, h) for _, t, h in rows[:9]], (3, "other text\n" + pool[0], "a"), (70, None, "a"), (71, "", "b")]
    normal = lambda x: " ".join(re.sub("[0-9]+", "0", x.lower()).split())
    held, hosts = defaultdict(set), defaultdict(set)
    for i, text, host in rows:
        hosts[host].add(i)
        for line in (text or "").split("\n"):
            if line.split():
                held[host, normal(line)].add(i)
    frequent = {k for k, ids in held.items() if len(ids) > 5 and len(ids) > 0.3 * len(hosts[k[0]])}
    gone = lambda text, host: sum(len(x.split()) for x in (text or "").split("\n") if (host, normal(x)) in frequent)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = rules.judge(df, min_docs=5, max_share=0.3).collect()
    expected = Counter((i, len((t or "").split()), gone(t, h)) for i, t, h in rows)
    assert frequent and Counter((r["doc_id"], r["n_words"], r["n_removed_words"]) for r in found) == expected


# language --------------------------------------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark, odd):
    words = {"en": "the house and river of green stone with many old trees".split(), "de": "das haus und der fluss aus grünem stein mit vielen bäumen".split()}
    rows = [(k, " ".join(words[lang][(k * 7 + j * j) % 11] for j in range(25)), lang) for k in range(80) for lang in words]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn(docs.where("doc_id % 3 <> 1"), dictionary_bytes=4000)
    assert set(learned) == {"en", "de"}
    found = langid.identify(docs.where("doc_id % 3 = 1").withColumn("doc_id", F.when(F.col("lang") == "en", 0).otherwise(1).cast("long")), learned).collect()
    assert all(r["lang_pred"] == ("en", "de")[r["doc_id"]] for r in found)
    for r in langid.identify(odd, learned).collect():
        text = ODD[4 if r["doc_id"] is None else r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not text or not any(c.isalpha() for c in text)) and 0 <= r["score"] <= 1
    assert langid.learn(docs.where("false")) == {} and langid.identify(odd, {}).where("lang_pred <> 'und'").count() == 0


# personal data ---------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return found + [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_plain_patterns_equal_the_definitions():
    import random

    draw = random.Random(5)
    for _ in range(6000):
        text = "".join(draw.choice("ab1239.@+- ()%_é4111") for _ in range(draw.randint(0, 40))) + draw.choice(["", "4111 1111 1111 1111", "+1 (555) 010-9999", "1.2.3.4.5", "a@b.c@d.e", "300.1.1.1"])
        assert sorted(pii.plain(text)) == sorted(slow_plain(text)), text


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to jоhn.dое@ехample.com now", "email", "jоhn.dое@ехample.com"),
        ("mail jane (at) example [dot] org soon", "email", "jane (at) example [dot] org"),
        ("reach bob at mail dot example dot net today", "email", "bob at mail dot example dot net"),
        ("call plus four nine one five one two three four five six seven eight please", "phone", "plus four nine one five one two three four five six seven eight"),
        ("card ４１１１ １１１１ １１１１ １１１１ ok", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("x​y a​@b​.com", "email", "a​@b​.com"),
    ],
)
def test_disguises_map_to_the_source(text, kind, part):
    spans = [s for s in pii.disguised(text, pii.plain(text)) if s[2] == kind]
    assert [text[a:b] for a, b, _ in spans] == [part] or any(part in text[a:b] for a, b, _ in spans)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("card four one one one one one one one one one one one one one one one ok", "card", "four" + " one" * 15),
        ("call plus one five five five one five five five one five five five", "phone", "plus one five five five one five five five one five five five"),
        ("call plus four nine 151 two three 45678 please", "phone", "plus four nine 151 two three 45678"),
        ("call +49 one five one 23 four five six seven eight please", "phone", "+49 one five one 23 four five six seven eight"),
        ("card four 111 1111-1111-111 one please", "card", "four 111 1111-1111-111 one"),
        ("room 12, four one one one one one one one one one one one one one one one ok", "card", "four" + " one" * 15),
        ("host 192.168.one.one or 10 dot one dot 0 dot 7 up", "ip", "192.168.one.one"),
        ("host 192.168.one.one or 10 dot one dot 0 dot 7 up", "ip", "10 dot one dot 0 dot 7"),
        ("reach bob at mail dot example dot ai today", "email", "bob at mail dot example dot ai"),
        ("reach bob at example dot test", "email", "bob at example dot test"),
        ("john dot smith at example.dev", "email", "john dot smith at example.dev"),
        ("jane [  at\t] example.app", "email", "jane [  at\t] example.app"),
        ("jane at example dot academy", "email", "jane at example dot academy"),
        ("x" * 90 + " at " + "y" * 80 + " dot org", "email", "x" * 90 + " at " + "y" * 80 + " dot org"),
        ("a.b.c.d.e.f.g.h.i.j.k (at) l.m.n.o.p.q.r.s.t.u.v.com", "email", "a.b.c.d.e.f.g.h.i.j.k (at) l.m.n.o.p.q.r.s.t.u.v.com"),
        ("juan arroba ejemplo punto es", "email", "juan arroba ejemplo punto es"),
        ("jean (arobase) exemple point fr", "email", "jean (arobase) exemple point fr"),
        ("ruf plus vier neun eins fünf eins zwei drei vier fünf sechs an", "phone", "plus vier neun eins fünf eins zwei drei vier fünf sechs"),
        ("au plus trois trois un quatre deux zéro neuf huit sept six ok", "phone", "plus trois trois un quatre deux zéro neuf huit sept six"),
        ("al más tres cuatro nueve uno dos cinco seis siete ocho cero ya", "phone", "más tres cuatro nueve uno dos cinco seis siete ocho cero"),
        ("card ٤١١١ ١١١١ ١١١١ ١١١١ ok", "card", "٤١١١ ١١١١ ١١١١ ١١١١"),
        ("ip १०.०.०.१ here", "ip", "१०.०.०.१"),
    ],
)
def test_disguises_pass_the_gates(text, kind, part):
    assert part in [text[a:b] for a, b, k in pii.disguised(text, pii.plain(text)) if k == kind]


def test_numbers_beside_words_are_no_disguise():
    for text in ("one of 12 34 567 890 123 456", "2024-11-28 10 11 12", "one 4111 1111 1111 1111", "look at the dot of 3 or four 5", "version one.2.3"):
        assert pii.disguised(text, pii.plain(text)) == [], text


@pytest.mark.parametrize(
    ("kind", "part"),
    [
        ("ip", "192[.]168[.]1[.]1"), ("ip", "10(dot)0(dot)0(dot)7"), ("ip", "192.168.one.1"), ("email", "max klammeraffe beispiel punkt de"), ("email", "j a n e at example dot com"),
        ("phone", "plus one double five five two three four five six seven eight"), ("phone", "plus forty four twenty seven nineteen sixty triple zero"), ("ip", "one ninety two dot one six eight dot one dot one"),
        ("ip", "one hundred and ninety two dot one hundred sixty eight dot ten dot two hundred fifty five"), ("card", "four    one, - one one one one one one one one one one one one one one"), ("ip", "zehn punkt zwanzig punkt dreißig punkt vierzig"),
    ],
)
def test_written_numbers_are_found_whole(kind, part):
    for before, after in (("See ", " now"), ("", ""), ("(", ")"), ("Ein Wort: ", ", danke")):
        text = before + part + after
        assert [(text[a:b], k) for a, b, k in pii.disguised(text, pii.plain(text))] == [(part, kind)]


@pytest.mark.parametrize(
    ("words", "number"),
    [("one ninety two", "192"), ("one hundred and ninety two", "192"), ("two hundred five", "205"), ("nineteen eighty four", "1984"), ("double oh seven", "007"), ("hundred", "100"), ("three hundred ten", "310"), ("ninety zero", "900"), ("plus 49 triple two", "+49222"), ("twenty twenty one", "2021"), ("one six eight", "168")],
)
def test_numbers_in_words(words, number):
    assert pii.written([w for w in words.split() if w != "and"]) == number


def test_disguises_in_the_corpus_are_found():
    """Planted disguises of every kind, in prose: nine of ten at least are found where they are, and clean texts stay clean."""
    import random

    draw, word = random.Random(8), lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 9)))
    spoken = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine"}
    spell = lambda s: " ".join(spoken.get(c, "plus") for c in s)
    makers = [
        lambda: (f"{word()} (at) {word()} [dot] {word()}", "email"),
        lambda: (f"{word()}.{word()} at {word()} dot com", "email"),
        lambda: (f"{word()}＠{word()}．org", "email"),
        lambda: (f"{word()}o@{word()}.net".replace("o", "о"), "email"),
        lambda: (spell("+4915" + "".join(draw.choice("0123456789") for _ in range(7))), "phone"),
        lambda: (" dot ".join(str(draw.randint(0, 255)) for _ in range(4)), "ip"),
        lambda: (spell("4111111111111111"), "card"),
        lambda: ("4111 1111 1111 1111".translate({ord("0") + k: chr(0xFF10 + k) for k in range(10)}), "card"),
    ]
    hits = total = 0
    for k in range(400):
        planted, kind = makers[k % len(makers)]()
        before, after = (" ".join(word() for _ in range(30)) for _ in range(2))
        text = f"{before}, {planted}; {after}"
        at = len(before) + 2
        hits += any(s <= at + 1 and e >= at + len(planted) - 1 and x == kind for s, e, x in pii.disguised(text, pii.plain(text)))
        total += 1
        assert pii.disguised(f"{before}. {after}", []) == []
    assert hits >= 0.9 * total, (hits, total)


def test_long_texts_are_scanned_in_one_pass():
    import time

    began = time.time()
    for text in ("a dot " * 60000, "a." * 150000 + " (at) b", "x" * 400000 + " at y", "(at) " * 60000, "one 1 " * 60000):
        pii.disguised(text, pii.plain(text))
    assert time.time() - began < 30


def test_clean_texts_have_no_spans():
    for text in ("meet us at example.com", "one day at the dot of noon", "two of three people, four times", PROSE, "polka dot dress at home"):
        assert pii.disguised(text, []) == [] and pii.plain(text) == []


def test_masking_and_odd_rows(spark, odd):
    found = pii.find(odd, redact=True)
    assert found.columns[:-1] == odd.columns and found.columns[-1] == "spans_" and found.count() == len(ODD) + 2
    assert pii.find(empty(odd)).count() == 0
    df = spark.createDataFrame([(1, "mail a@b.co or +1 555 010 9999"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.find(df, redact=True).collect()} == {1: "mail [EMAIL] or [PHONE]", 2: None}


# token counts ----------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in tokencount.prefix_counts(odd, path).collect():
        text = ODD[4 if r["doc_id"] is None else r["doc_id"]] or ""
        assert (r["prefix_tokens"] or [0])[-1] == n(text) and r["n_bytes"] == len(text.encode())
    assert tokencount.prefix_counts(empty(odd), path).count() == 0
    counter = tokencount.counter(path)
    for word in ("internationalisation", "zzzzaaaathth", "über"):
        assert counter.prefixes[word][-1] == n(word)
        assert [counter.prefixes[word][len(word[:k].encode()) - 1] for k in range(1, len(word) + 1)] == [n(word[:k]) for k in range(1, len(word) + 1)]
        short = tokencount.truncated_word(word, 1, path)
        assert n(short) <= 1
    words = "one two three international"
    at = counter.at_words(words)
    assert tokencount.words_within(at, at[1]) == 2


# sentence pieces -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [0, 3, 1 << 10])
def test_pieces_equal_the_library(spark, odd, hot):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    more = ["a" * 30000 + "b", "  two  blanks ", "▁own▁ mark", "\n\nlines\n of text \n", "no1digit2joins, (signs)!? “quotes”", "été où ça 数据 🙂🙂 \x00 \u200b" * 3, " ".join("antidis" * (1 + k % 40) for k in range(400))]
    texts = odd.unionByName(table(spark, more).withColumn("doc_id", F.col("doc_id") + 100))
    found = pieces.decode(pieces.encode(texts, path, hot=hot), path, name="back").collect()
    assert len(found) == texts.count()
    for r in found:
        text = more[r["doc_id"] - 100] if (r["doc_id"] or 0) >= 100 else ODD[4 if r["doc_id"] is None else r["doc_id"]] or ""
        assert list(r["piece_ids"]) == library.encode(text) and r["back"] == text.replace("▁", " ")
    assert pieces.encode(empty(odd), path).count() == 0


def test_units_and_ids_read_back():
    import numpy as np
    import random
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    m, library, draw = pieces.model(path), SentencePieceProcessor(model_file=path), random.Random(4)
    for _ in range(300):
        text = "".join(draw.choice("ab the  \n,.()1é数🙂▁") for _ in range(draw.randint(0, 60)))
        assert "".join("▁" + p for p in pieces.parts_of(text)) == ("▁" + text.replace(" ", "▁") if text else "")
        assert all("".join(m.units_of(p)) == "▁" + p for p in pieces.parts_of(text))
        units = [u for p in pieces.parts_of(text) for u in m.units_of(p)]
        assert [x for u in units for x in (m.single(u) if len(u) == 1 else library.encode(u[1:]) if u[0] == "▁" else library.encode("\n" + u)[2:])] == library.encode(text)
    for _ in range(200):
        ids = [draw.choice([3 + 0xE2, 3 + 0x82, 3 + 0xAC, 3 + 0x0A, 1, 300, 5000]) for _ in range(draw.randint(0, 12))]
        assert m.text(np.array(ids, np.int64)) == library.decode(ids)


def test_texts_are_cut_once(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(odd, path, hot=3, decoded="back")
    read = pieces.decode(pieces.encode(odd, path, hot=3), path, name="back")
    assert sorted(encoded.collect(), key=str) == sorted(read.collect(), key=str)
    assert "ReusedExchange" in encoded._jdf.queryExecution().executedPlan().toString()


def test_codes_of_units_with_equal_hashes(monkeypatch):
    import numpy as np
    import pyarrow as pa

    m, hashed = pieces.model(public_tokenizers.path("piece_bpe_32k.model")), pieces.hashed
    top = pa.table({"unit": pa.array(["▁ab", "▁cd", "▁été"]), "ids": pa.array([[1], [2], [3]], pa.list_(pa.int32()))})
    asked = pa.array(["skipped", "▁cd", "no", "", "▁été", "▁ab", "a"])[1:]
    found = pieces.Codes(m, top).find(asked)
    assert (found > 0).tolist() == [True, False, False, True, True, True]
    monkeypatch.setattr(pieces, "hashed", lambda units: hashed(units) & np.uint64(15))
    assert pieces.Codes(m, top).find(asked).tolist() == found.tolist()


def test_pairs_of_one_place(monkeypatch):
    import numpy as np

    monkeypatch.setattr(pieces, "PAIRS", 4)
    m = pieces.Model(public_tokenizers.path("piece_bpe_32k.model"))
    ids = [k for k in range(300, 340) if m.alone[m.pieces[k]]]
    pairs = np.unique([a << 32 | b for a in ids for b in ids])
    told = [not m.crossed(k >> 32, k & 0xFFFFFFFF) for k in pairs.tolist()]
    assert m.fits(pairs).tolist() == m.fits(pairs).tolist() == told and not all(told)


# near duplicates -------------------------------------------------------------------------------------------------------


def slow_classes(texts):
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = WORD.findall(w)
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    of = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                lo, hi = sorted((of[a], of[b]))
                of = [lo if x == hi else x for x in of]
    return {k: (len(sets[k]), of[k]) for k in range(len(texts))}


def test_components_equal_brute_force(spark):
    import random

    draw = random.Random(3)
    base = [[f"w{draw.randint(0, 400)}" for _ in range(n)] for n in (5, 40, 120, 300)]
    texts = ["", None, "One", "one", "one two", "a b c", "A B C"]
    for words in base:
        for edits in [0, 0, 1, 1, 2, 3, 5, 8, 13]:
            w = list(words)
            for _ in range(edits):
                w[draw.randrange(len(w))] = f"x{draw.randint(0, 9)}"
            texts.append(" ".join(w))
    found = jaccard.classes(table(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == slow_classes(texts)


@pytest.mark.parametrize("leaf", [2, 3, 16])
def test_tree_join_finds_every_pair_that_may_link(monkeypatch, leaf):
    import numpy as np

    monkeypatch.setattr(jaccard, "LEAF", leaf)
    draw = np.random.default_rng(6)
    for n in (1, 2, 5, 70):
        base = draw.integers(0, 1 << 62, 400).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[: draw.integers(1, 400)], draw.integers(0, 1 << 62, draw.integers(0, 30)).astype(np.uint64)])) for _ in range(n)]
        points, sizes = jaccard.Points([jaccard.point_of(h) for h in sets]), np.array([len(h) for h in sets])
        found = {tuple(sorted(p)) for x, y in jaccard.tree_join(points, sizes) for p in zip(x.tolist(), y.tolist(), strict=True)}
        links = {(a, b) for b in range(n) for a in range(b) if 100 * (same := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (len(sets[a]) + len(sets[b]) - same)}
        assert links <= found and (n < 70 or len(links) > 50)


def test_large_pages_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    common = [f"c{k}" for k in range(60)]
    texts = [" ".join([*common[: 60 - j % 7], *[f"u{j % 5}_{k}" for k in range(j % 9)]]) for j in range(40)]
    found = jaccard.classes(table(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == slow_classes(texts)


def test_links_inside_components_are_counted(spark, monkeypatch):
    common = [f"c{k}" for k in range(300)]
    texts = [" ".join([*common, f"u{j}"]) for j in range(30)] + [" ".join(common[: 300 - 9 * j]) for j in range(12)] + [" ".join([*common, "u3"])] * 3 + ["a b c", "A b C", "d", None, ""]
    sets = [{tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if (w := (t or "").lower().split()) else set() for t in texts]
    link = lambda x, y: bool(x) and 100 * len(x & y) >= 85 * len(x | y)
    expected = {a: sum(link(x, y) for b, y in enumerate(sets) if a != b) for a, x in enumerate(sets)}
    assert expected[0] > 29 and len(set(expected.values())) > 4
    for grams, width in ((1 << 20, 4096), (1500, 50)):
        monkeypatch.setattr(jaccard, "GRAMS", grams, raising=False)
        monkeypatch.setattr(jaccard, "WIDTH", width, raising=False)
        found = jaccard.classes(table(spark, texts)).collect()
        assert {r["doc_id"]: r["n_links"] for r in found} == expected


def test_join_on_odd_rows(spark, odd):
    found = jaccard.classes(odd).collect()
    assert len(found) == len(ODD) + 2
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None and r["doc_id"] != 4} == {k: k for k in range(len(ODD)) if k != 4}
    assert jaccard.classes(empty(odd)).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and jaccard.one_of_each(empty(odd)).count() == 0
    assert {r["doc_id"] for r in kept.collect()} == {*range(len(ODD)), None}


def test_word_hashes_do_not_depend_on_their_place(monkeypatch):
    monkeypatch.setattr(jaccard, "STEP", 64)
    jaccard._tables.cache_clear()
    text = ("Some words here " * 30 + "x" * 1000 + " some").encode()
    h = jaccard.word_hashes(text)
    assert len(h) == 92 and len(set(h.tolist())) == 4 and h[0] == h[-1]
    monkeypatch.undo()
    jaccard._tables.cache_clear()
    assert (jaccard.word_hashes(text) == h).all()


# decontamination -------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_hits(text, items):
    lower = lambda t: TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, inside, names = lower(text), set(), set()
    for name, item in items:
        x = lower(item)
        n = min(10, len(x))
        windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                inside.update(range(k, k + n))
                names.add(str(name))
    return len(w), len(inside), sorted(names)


@pytest.mark.parametrize("item_bytes", [1 << 20, 200])
def test_matches_equal_brute_force(spark, odd, item_bytes):
    items = [(1, PROSE), (2, "Quick brown FOX"), (3, "über-alles 日本"), (4, None), (5, ""), (1, "word"), (12, " ".join(PROSE.split()[5:18]) + " end"), (6, "a b a b a b a b a b a b")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    extra = table(spark, ["so QUICK, brown fox!", PROSE[:60], PROSE[10:90] + " x " + PROSE[30:], "Über alles 日本"]).withColumn("doc_id", F.col("doc_id") + 100)
    texts = dict(enumerate(ODD)) | {r["doc_id"]: r["text"] for r in extra.collect()}
    found = decontam.find_matches(odd.unionByName(extra), benchmark, item_bytes=item_bytes)
    assert found.columns[-1] == "matches_"
    for r in found.withColumn("hit", decontam.covered(F.col("matches_"))).collect():
        n, hit, names = slow_hits(texts[4 if r["doc_id"] is None else r["doc_id"]], items)
        assert (r["n_words"], r["hit"], sorted({m["item_id"] for m in r["matches_"]})) == (n, hit, names)
    assert decontam.find_matches(empty(odd), benchmark).count() == 0
    assert decontam.decontaminate(odd, benchmark.where("false")).count() == odd.count()


def test_windows_take_bounded_memory_a_word():
    import tracemalloc

    words = [b"w%d" % (k * k % 2003) for k in range(3000)]
    test = decontam.TestSuffixes([("a", " ".join(w.decode() for w in words[:200]))], 10)
    docs = [words[:12] + [words[5]] * 140 for _ in range(1000)]
    tracemalloc.start()
    try:
        found = decontam.shard_matches(docs, test)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found[0]) >= 1000 and peak / sum(map(len, docs)) < 120


def test_matches_are_as_long_as_they_can_be(spark):
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[5:30]) + " c"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert [tuple(m) for m in decontam.find_matches(docs, bench).where("doc_id = 1").first()["matches"]] == [("7", 5, 2, 25)]
    assert [r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()] == [2]


# quality classifier ----------------------------------------------------------------------------------------------------


def good_and_bad():
    import random

    draw = random.Random(2)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    sentence = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n)).capitalize() + "."
    good = ["\n".join(sentence(12) for _ in range(8)) for _ in range(150)]
    bad = [" ".join(w + "***" for w in sentence(60).split()) for _ in range(15)] + [" !! ".join(sentence(60).upper().split()) for _ in range(15)] + [" ".join([w for w in sentence(9).split() for _ in range(9)]) for _ in range(15)]
    return good, bad


def test_classifier_tells_good_from_bad(spark, odd):
    good, bad = good_and_bad()
    docs = table(spark, good + bad)
    model = quality.learn(docs)
    scored = {r["doc_id"]: r["score_"] for r in quality.score(docs, model).collect()}
    assert sum(scored[k] >= quality.THRESHOLD for k in range(len(good))) >= 0.99 * len(good)
    assert sum(scored[k] < quality.THRESHOLD for k in range(len(good), len(good + bad))) >= 0.95 * len(bad)
    found = quality.score(odd, model).collect()
    assert len(found) == len(ODD) + 2 and all(0 <= r["score_"] <= 1 for r in found)
    assert all(r["score_"] == 0 for r in found if r["doc_id"] in (0, 1, 2, 3))
    assert quality.accept(empty(odd)).count() == 0 and quality.accept(docs).columns == docs.columns


def test_posteriors_find_reliable_labellers():
    import random

    draw = random.Random(1)
    counts = Counter()
    for _ in range(5000):
        y = draw.random() < 0.7
        votes = [y if draw.random() < p else not y for p in (0.95, 0.9, 0.8, 0.55)]
        counts["".join("1" if v else "0" for v in votes)] += 1
    found = quality.posteriors(counts)
    assert found["1110"] > 0.95 and found["0001"] < 0.05 and quality.posteriors({}) == {}


def test_points_of_few_pairs_are_unpacked_at_a_time(monkeypatch):
    import numpy as np
    import pyarrow as pa

    most, made = [], jaccard.Points
    monkeypatch.setattr(jaccard, "PAIRS", 3)
    monkeypatch.setattr(jaccard, "Points", lambda counts: most.append(len(counts)) or made(counts))
    sets = [np.sort(jaccard.mixed(np.arange(k // 2, k // 2 + 20 + k % 3 * 400, dtype=np.uint64))) for k in range(20)]
    pairs = [(a, b) for a in range(20) for b in range(a)]
    column = lambda f, side: pa.array([f(sets[p[side]]) for p in pairs])
    batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), column(len, 0), column(len, 1), column(jaccard.point_of, 0), column(jaccard.point_of, 1)], ["a", "b", "na", "nb", "x", "y"])
    got = {(r["a"], r["b"]) for t in jaccard.near_pairs(iter([batch, batch.slice(0, 0)]), 85) for r in t.to_pylist()}
    want = {(a, b) for a, b in pairs if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert want and want <= got and len(got) < len(pairs)
    assert max(most) == 3

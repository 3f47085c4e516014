"""Fingerprints, conversation repair and the filter audit against plain Python, and on odd rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from corpusloom.llm import audit, fingerprint, repair  # noqa: E402
from corpusloom.llm.common import Shared, lookup  # noqa: E402

from .test_operators import ODD, odd, table  # noqa: E402, F401

# fingerprints ----------------------------------------------------------------------------------------------------------

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*words):
    """Spark's hash of strings: each one's seeds the next, and nulls are passed over."""
    seed = 42
    for w in words:
        if w is not None:
            seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return signed(seed)


def brute_fingerprint(text, samples):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    weights = Counter(hashed(w, n) for w, n in itertools.zip_longest(words, words[1:])) or {0: 1}
    out = []
    for d in range(samples):
        found = []
        for term, n in weights.items():
            key = (term ^ ((d + 1) * 0x1E3779B97F4A7C15 % (1 << 63))) & MASK
            x = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), seed=42)
            r, b, u = fingerprint.OF_R[x & 255], ((x >> 8 & 0xFFFFFF) + 0.5) / 2**24, ((x >> 32) + 0.5) / 2**32
            log_c = math.log(u) * 0.5 + fingerprint.OF_C[x >> 56]
            t = math.floor(math.log(n) / r + b)
            found.append((math.floor((log_c - r * (t + 1 - b) + 100) * 2**24), (term ^ t * 2654435761) & 0xFFFFFFFF))
        out.append(f"{min(found)[1]:08x}")
    return "".join(out)


def brute_edits(rows):
    """rows: doc_id, text."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    for k, (d, text) in enumerate(rows):
        follower = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        yield d, text, text[: len(text) - half] + follower[:half], follower


def same(a, b):
    return sum(a[k : k + 8] == b[k : k + 8] for k in range(0, len(a), 8)) / (len(a) // 8)


@pytest.mark.parametrize("range_rows", [1, 3, 1000])
def test_edits_equal_plain_python(spark, odd, range_rows):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted((d is None, d or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), brute_fingerprint(t, 6), brute_fingerprint(e, 6), same(brute_fingerprint(t, 6), brute_fingerprint(e, 6)), same(brute_fingerprint(t, 6), brute_fingerprint(n, 6))) for d, t, e, n in brute_edits(rows))
    found = fingerprint.edits(odd, samples=6, range_rows=range_rows).collect()
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in found) == want


def test_edits_of_many_ranges_of_uneven_ids(spark):
    rows = [(k * k * 7 % 100_003 - 50_000, f"text {k} of words {k % 5} " * (k % 7)) for k in range(700)]
    found = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.edits(spark.createDataFrame(rows, "doc_id long, text string"), samples=1, range_rows=2).collect()}
    assert found == {d: hashlib.sha256(e.encode()).hexdigest() for d, _, e, _ in brute_edits(rows)}


def test_edits_of_one_row_and_of_none(spark, odd):  # noqa: F811
    one = fingerprint.edits(spark.createDataFrame([(7, "abcd efgh")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcd abcd").hexdigest() and one[0]["near_next"] == 1.0
    assert fingerprint.edits(spark.createDataFrame([(None, "a b"), (None, "c d")], "doc_id long, text string")).count() == 2
    assert fingerprint.edits(odd.where("false")).count() == 0


def test_agreement_follows_generalised_jaccard(spark):
    """Mean agreement over many pairs of texts with repeated words."""
    rows, want = [], []
    for k in range(300):
        words = [f"w{k}x{j}" for j in range(12)]
        a = [w for j, w in enumerate(words) for _ in range(1 + j % 4)]
        b = [w for j, w in enumerate(words) for _ in range(1 + (j + k) % 3)] + [f"o{k}"] * 3
        # single words as terms: each is put between others that are alike
        rows.append((k, " ".join(a), " ".join(b)))
        grams = lambda x: Counter(itertools.zip_longest(x, x[1:]))
        p, q = grams(a), grams(b)
        want.append(sum((p & q).values()) / sum((p | q).values()))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    both = fingerprint.sign(df, ["k"], "a").join(fingerprint.sign(df, ["k"], "b").withColumnRenamed("fingerprint", "other"), "k")
    near = [r[0] for r in both.select(fingerprint.likeness(F.col("fingerprint"), F.col("other"))).collect()]
    assert abs(sum(near) / len(near) - sum(want) / len(want)) < 0.015
    assert all(abs(x - y) < 0.45 for x, y in zip(near, want, strict=False))


# conversation repair ---------------------------------------------------------------------------------------------------

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute_damage(rows):
    for c, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{said(c)}:{said(turn)}".encode()) % 20, said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(2 if kind == 3 else 1):
            yield c, turn, "user" if kind == 4 else role, text


def brute_repair(rows):
    """The cheapest edits by Dijkstra-like search over (row, grammar state), with whole audits compared."""
    seen, faults = set(), []
    for role, text in rows:
        s = text.strip(SPACE)
        faults.append("blank" if not s else "duplicate" if (role, text) in seen else "truncated" if s[-1] not in ".!?" else "none")
        seen.add((role, text))
    # states: what may follow; reached by the initial just given
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {}

    def better(k, q, cost, audit, out):
        if (k, q) not in best or (cost, audit) < best[k, q][:2]:
            best[k, q] = cost, audit, out
            return True
        return False

    work = [(0, "")]
    better(0, "", 0, "", ())
    while work:
        k, q = work.pop(0)
        cost, audit, out = best[k, q]
        moves = []
        for name in ("user", "assistant"):
            if (q, name[0]) in step:
                moves.append((k, step[q, name[0]], 3, "I", ((name, ""),)))
                if k < len(rows) and faults[k] not in ("blank", "duplicate"):
                    moves.append((k + 1, step[q, name[0]], 3 + 3 * (faults[k] == "truncated"), "R", ((name, rows[k][1]),)))
        if k < len(rows):
            moves.append((k + 1, q, 4, "D", ()))
            if faults[k] not in ("blank", "duplicate") and (q, rows[k][0][:1]) in step:
                moves.append((k + 1, step[q, rows[k][0][:1]], 3 * (faults[k] == "truncated"), "K", (rows[k],)))
        for k2, q2, more, edit, said in moves:
            if cost + more <= 4 * len(rows) + 6 and better(k2, q2, cost + more, audit + edit, out + said):
                work.append((k2, q2))
    ends = [best[len(rows), q] for q in ("", "a") if (len(rows), q) in best]
    return faults, min(ends, key=lambda x: x[:2])


def brute_audit(rows):
    want = []
    damaged = list(brute_damage(rows))
    for c in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, (cost, audit_, out) = brute_repair([r[2:] for r in own])
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        count = Counter(faults)
        want.append((str(c), gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit_, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()))
    return sorted(want)


ROLES = ["user", "assistant", "system", "tool", "", None, "User"]
TEXTS = ["Fine.", "Why?", "cut off", " ", "", None, "Done! \n", "Same.", "Ünï 日本!", "x" * 300 + "."]


def said(n, longest=9):
    """Conversations of odd rows, by arithmetic."""
    rows = []
    for c in range(n):
        for t in range((c * 7 + 3) % longest + 1):
            h = zlib.crc32(f"{c}/{t}".encode())
            turn = None if h % 17 == 0 else t + (h % 3 if c % 4 == 0 else 0)
            role = ROLES[h // 7 % len(ROLES)] if c % 3 == 0 else ("user", "assistant")[t % 2] if t or c % 2 else "system"
            rows.append((c if c != 5 else None, turn, role, TEXTS[h // 61 % len(TEXTS)]))
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


def audited(df):
    return sorted((str(r["conv_id"]), r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in repair.audit(repair.numbered(repair.damage(df))).collect())


def test_repair_equals_a_search_of_all_edits(spark):
    rows = said(240)
    assert audited(spark.createDataFrame(rows, COLUMNS).withColumns({"copy": F.lit("clash"), "dropped": F.lit("clash"), "pos": F.lit(1)})) == brute_audit(rows)


def test_repeated_rows_dropped_conversations_and_none(spark):
    dropped = [(c, t, "user", "Hi.") for c in range(60) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows = [*said(8), *said(8), *dropped]
    assert dropped and audited(spark.createDataFrame(rows, COLUMNS)) == brute_audit(rows)
    assert audited(spark.createDataFrame([], COLUMNS)) == []


def test_repair_of_a_long_conversation(spark):
    rows = [(1, t, ROLES[zlib.crc32(bytes([t % 251, t // 251])) % 4], f"{t % 97} words" + ".!? x"[t % 5]) for t in range(3000)]
    found = spark.createDataFrame(rows, COLUMNS)
    out = repair.audit(repair.numbered(repair.damage(found))).collect()[0]
    assert (out["cost"], out["audit"]) == brute_cost([r[2:] for r in brute_damage(rows)])


def brute_cost(rows):
    """Cost and audit by a plain table from the end; audits are compared by their first letters, which differ."""
    seen, faults = set(), []
    for role, text in rows:
        s = text.strip(SPACE)
        faults.append(1 if not s or (role, text) in seen else 2 if s[-1] not in ".!?" else 0)
        seen.add((role, text))
    follow, target = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}, {"": "u", "s": "u", "u": "a", "a": "u"}
    tables = [{"": (0, ""), "a": (0, ""), "s": (6, "I"), "u": (3, "I")}]
    for (role, _), fault in zip(rows[::-1], faults[::-1], strict=True):
        after, own = tables[-1], {}
        for q in target:
            ways = [(after[q][0] + 4, "D")]
            if fault != 1:
                ways.append((after[target[q]][0] + 3 + 3 * (fault == 2), "R"))
                if (q, role[:1]) in follow:
                    ways.append((after[follow[q, role[:1]]][0] + 3 * (fault == 2), "K"))
            own[q] = min(ways)
        for _ in range(3):
            own = {q: min(v, (own[target[q]][0] + 3, "I")) for q, v in own.items()}
        tables.append(own)
    q, k, out = "", len(rows), []
    while tables[k][q][1]:
        edit = tables[k][q][1]
        out.append(edit)
        if edit != "D":
            q = follow[q, rows[len(rows) - k][0][:1]] if edit == "K" else target[q]
        k -= edit != "I"
    return tables[len(rows)][""][0], "".join(out)


def test_repaired_rows_follow_the_grammar(spark):
    found = defaultdict(list)
    for r in repair.repair(spark.createDataFrame(said(60), COLUMNS).withColumns({"copy": F.lit("clash"), "dropped": F.lit("clash")})).collect():
        found[r["conv_id"]].append((r["at"], r["role"]))
    assert all(re.fullmatch("s?(ua)+", "".join(role[:1] for _, role in sorted(x))) for x in found.values())


def test_the_automaton_stays_small(spark):
    nodes = {repair.END[0]}
    letters = [repair.letter(r, f) for r in range(4) for f in range(3)]
    while True:
        more = nodes | {repair.node(x, n)[0] for n in nodes for x in letters}
        if len(more) == len(nodes):
            break
        nodes = more
    assert len(nodes) < 400


# filter audit ----------------------------------------------------------------------------------------------------------


def brute_failed(rows, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1} for k in range(2))
    for d, text, part in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), d is not None and any(x is not None and x < d and (t or "") == text for x, t, _ in rows)]
        yield part or "", tuple(fails), d is not None and d in good, d is not None and d in toxic


def brute_interactions(failed):
    out = {}
    for part in {f[0] for f in failed}:
        own = [f[1:] for f in failed if f[0] == part]
        removed = Counter()
        for order in itertools.permutations(range(5)):
            for k, f in enumerate(order):
                before = order[:k]
                here = [x for x in own if x[0][f] and not any(x[0][b] for b in before)]
                removed[f] += len(here)
                out[part, "".join("ABCDE"[x] for x in order), k + 1] = [
                    sum(not any(x[0][b] for b in order[: k + 1]) for x in own), len(here), sum(x[0][f] and any(x[0][b] for b in before) for x in own),
                    sum(x[0][f] and sum(x[0]) == 1 for x in own), sum(x[1] for x in here), sum(x[2] for x in here), f,
                ]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = removed[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_brute_force(spark, odd):  # noqa: F811
    more = ["word " * 250, "ALL CAPS " * 120 + "end", " ".join(f"w{k}" for k in range(300)), "50% of it", "\x0b\x0c", "é" * 30 + " É A"]
    docs = odd.unionByName(table(spark, more, None).withColumn("doc_id", F.col("doc_id") + 20)).unionByName(table(spark, more[:3] + ODD[:4], "t").withColumn("doc_id", F.col("doc_id") + 40))
    labels = [(1, 1, 0), (3, None, 1), (20, 0, 1), (20, 1, 0), (41, 1, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    shared = Shared(spark)
    failed = audit.failures(docs.repartition(3), df, shared)
    want = list(brute_failed(rows, labels))
    bits = lambda x: sum(1 << k for k, f in enumerate(x) if f)
    assert sorted((r["part"], r["failed"], r["good"], r["toxic"]) for r in failed.collect()) == sorted((p, bits(f), g, t) for p, f, g, t in want)
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in audit.interactions(failed).collect()}
    assert found == brute_interactions(want)
    assert audit.interactions(audit.failures(docs.where("false"), df, shared)).count() == 0


def test_matrix_shards_hold_all_words(spark, odd):  # noqa: F811
    shared = Shared(spark)
    matrix = audit.Matrix(odd.select("doc_id", "text").repartition(3), shared, groups=5)
    names = {r["column"]: r["word"] for r in matrix.dictionary().collect()}
    assert len(set(names.values())) == len(names)
    found = []
    for r in matrix.shards().collect():
        for doc, a, b in zip(r["docs"], r["starts"], r["starts"][1:], strict=False):
            found.append((str(doc["doc_id"]), sorted((names[c], n) for c, n in zip(r["columns"][a:b], r["counts"][a:b], strict=True))))
    words = lambda t: sorted(Counter(w for w in re.split("[\x20\x09-\x0d]+", t or "") if w).items())
    assert sorted(found) == sorted((str(r["doc_id"]), words(r["text"])) for r in odd.collect())


def test_lookup_deals_frequent_keys_apart(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}" if k % 6 else None) for k in range(60)], "id int, key string")
    copies = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    found = {r["id"]: r["first"] for r in lookup(rows, copies, "key", 60, 0.1).collect()}
    assert len(found) == 60 and found[1] == 1 and found[59] == 1 and found[3] == 3 and found[0] is None

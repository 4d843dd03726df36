"""Importance resampling, conversation repair and passage removal against brute force."""

import hashlib
import heapq
import math
import random
import zlib

import pytest
from compare import duck, same

from lumenframe.llm import conversations, registry, resample, substring_dedup

DOCS = "doc_id bigint, text string, source string, row bigint, key string, rank int, runs string, _all string"


def docs(spark, texts, ids=None):
    ids = ids or [None if i == 3 else i for i in range(len(texts))]
    return spark.createDataFrame([(k, t, "s", i, "k", 1, "r", "a") for i, (k, t) in enumerate(zip(ids, texts))], DOCS)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_conversation_repair", "op13_substring_dedup"])
def test_sql(spark, small, name):
    same(registry.QUERIES[name](spark, small).toPandas(), duck(small).sql(registry.SQL[name]).df())


# importance resampling


def brute_runs(text, width):
    kept = "".join(c if c.isalnum() and c < "\x80" or c >= "\x80" else " " for c in (text or "").translate({i: i + 32 for i in range(65, 91)}))
    w = [x for x in kept.split(" ") if x]
    return len(w), [" ".join(w[i : i + n]) for n in range(1, width + 1) for i in range(len(w) - n + 1)]


def brute_resample(rows, target, width, buckets, least, percent, seed):
    put = lambda r: zlib.crc32(r.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    own = [brute_runs(x, width) for _, x in rows]
    for _, r in own:
        for x in r:
            s[put(x)] += 1
    for x in target:
        for r in brute_runs(x, width)[1]:
            t[put(r)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for (i, _), (n, r) in zip(rows, own):
        weight = sum(gain[put(x)] for x in r) // len(r) if r else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(r), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((-x[3], -1 if x[0] is None else x[0], k) for k, x in enumerate(out) if x[4])
    rank = {k: j + 1 for j, (_, _, k) in enumerate(able[: percent * len(able) // 100])}
    return [(*x[:4], rank.get(k)) for k, x in enumerate(out)]


@pytest.mark.parametrize("width,buckets,least", [(1, 10_000, 20), (2, 50, 3)])
def test_resample(spark, width, buckets, least):
    pick = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["É", "ß", "X9"]
    texts = [" ".join(pick.choices(words, k=pick.choice([0, 1, 5, 19, 20, 21, 90]))) for _ in range(300)]
    texts = texts + texts[7:8] * 600 + [None, "", ",.;", "Long " * 30_000, "a-b_c\x00d\x7fe"]
    aimed = ["w1 w2 w3 É", None, "", "w1 w1"]
    got = resample.resample(docs(spark, texts), spark.createDataFrame([(t,) for t in aimed], "text string"), width=width, buckets=buckets, least_words=least, percent=30).collect()
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)]
    want = brute_resample(rows, aimed, width, buckets, least, 30, "2024")
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_resample_edges(spark):
    none = docs(spark, [])
    target = spark.createDataFrame([], "text string")
    assert resample.resample(none, target).collect() == []
    twice = docs(spark, ["x " * 25] * 40, [8] * 40)  # one id and one text: ranks follow each other
    got = resample.resample(twice, target).collect()
    assert len({(r["weight"], r["score"]) for r in got}) == 1 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]


# conversation repair


def brute_repair(rows):
    """(turn, role, text) in order -> what the operator returns, by Dijkstra over whole conversations."""
    blank = [not t.strip(" \t\n\x0b\x0c\r") for _, _, t in rows]
    dup = [not b and (r, t) in [x[1:] for x in rows[:i]] for i, ((_, r, t), b) in enumerate(zip(rows, blank))]
    cut = [not b and not d and t.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" for (_, _, t), b, d in zip(rows, blank, dup)]
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, s, said = heapq.heappop(heap)
        if i == len(rows) and s in ("", "a"):
            break
        if (i, s, audit[-1:] == "I") in done:
            continue
        done.add((i, s, audit[-1:] == "I"))
        nxt = step[s]
        heapq.heappush(heap, (cost + 2, audit + "I", i, nxt, (*said, full[nxt] + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s, said))
            if not blank[i] and not dup[i]:
                late = int(cut[i])
                heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, nxt, (*said, f"{full[nxt]}:{text}")))
                if role[:1] == nxt or role[:1] == "s" and s == "":
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1], (*said, f"{role}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, sum(blank), sum(dup), sum(cut), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def chats(n, seed):
    pick = random.Random(seed)
    out = {}
    for c in range(n):
        size = pick.choice([1, 2, 3, 5, 8, 13, 40])
        out[f"c{c}" if c else None] = [
            (None if k == 0 and c % 4 == 0 else k + pick.choice([0, 0, 0, 1]) * 0 + (2 if k > 3 else 0), pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "umpire"]), pick.choice(["Yes.", "no", " \n", "Why? ", "Hm! x", f"t{k}.", f"t{k}"]))
            for k in range(size)
        ]
    return out


@pytest.mark.parametrize("piece,fan", [(256, 256), (3, 2), (1, 3)])
def test_repair(spark, piece, fan):
    given = chats(60, 11)
    flat = [(c, *r) for c, rows in given.items() for r in rows]
    random.Random(1).shuffle(flat)
    got = conversations.repair(spark.createDataFrame(flat, "conv string, turn bigint, role string, text string"), piece, fan).collect()
    assert {r["conv"]: tuple(r)[1:] for r in got} == {c: brute_repair(rows) for c, rows in given.items()}


def test_repair_edges(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, place int, sig string"
    rows = [(1, 0, None, None, 1, ""), (1, 1, "user", "Hi.", 1, ""), (None, None, "user", "x" * 300_000, 1, ""), (1, 2, "assistant", "Yes.", 1, "")]
    given = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in conversations.with_all(given, conversations.repair(given.selectExpr("cast(conv_id as string) conv", "turn", "role", "text"))).collect()}
    assert got[1]["audit"] == "DKK" and got[1]["blank"] == 1 and got[1]["illegal"] == 1
    assert got[None]["audit"] == "D" and got[None]["truncated"] == 1 and got[None]["cost"] == 3 and got[None]["gaps"] == 0  # KI costs as much
    none = spark.createDataFrame([], schema)
    assert conversations.with_all(none, conversations.repair(conversations.damaged(none))).collect() == []
    assert conversations.with_all(given, conversations.repair(conversations.damaged(none))).count() == 2
    out = conversations.with_all(given, conversations.repair(conversations.damaged(none))).first()
    assert (out["cost"], out["audit"], out["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


# passages


def brute_passages(rows, window):
    seen, out = set(), {}
    for k, (i, text) in enumerate(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            w = tuple(words[a : a + window])
            if w in seen:
                gone[a : a + window] = [True] * window
            seen.add(w)
        out[k] = (i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


@pytest.mark.parametrize("window,seed,group,held,light", [(20, 3, 4096, 100_000, 1 << 20), (5, 2, 3, 4, 0), (5, 2, 4096, 1, 0)])
def test_passages(spark, window, seed, group, held, light):
    pick = random.Random(window + group)
    words = [f"w{i}" for i in range(30)] + ["É\x1cx", "x" * 300, "x" * 300 + "y", "y" * 254, "\xa0"]
    base = [" ".join(pick.choices(words, k=pick.choice([0, 3, 25, 60, 200]))) for _ in range(60)]
    shared = " ".join(pick.choices(words, k=40))
    texts = base + base[:20] + [f"{shared} {t}" for t in base[10:30]] + [shared] * 300 + ["a " * 3000, None, "", " \t\n", "a\tb\x0bc " * 50]
    texts += [f"p{k} {shared[: len(shared) // 2]} q{k} " + " ".join(pick.choices(words[:3], k=80)) for k in range(30)]
    pick.shuffle(texts)
    rows = list(enumerate(texts))
    got = substring_dedup.dedup_passages(docs(spark, texts, [i for i, _ in rows]), window=window, seed=seed, group=group, held=held, light_bytes=light).collect()
    want = {v[0]: v for v in brute_passages(rows, window).values()}
    assert {r["doc_id"]: tuple(r) for r in got} == want and len(got) == len(rows)


def test_passages_edges(spark):
    assert substring_dedup.dedup_passages(docs(spark, [])).collect() == []
    text = " ".join(f"u{i}" for i in range(30))
    got = substring_dedup.dedup_passages(docs(spark, [text, text, text, "short"], [None, 4, 4, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got) == [("4", 30, 30), ("4", 30, 30), ("None", 1, 0), ("None", 30, 0)]


def test_word_code_is_lossless():
    v = substring_dedup.Vocabulary([f"f{i}".encode() for i in range(substring_dedup.CODED)])
    words = [b"f0", b"f99", b"f100", b"f39779", b"f39780", b"z" * 254, b"z" * 255, b"z" * 70_000, b"\xff\xff"]
    packed = b"".join(v.codes[v[w]] for w in words)
    ends = substring_dedup.word_ends(packed)
    assert ends[-1] == len(packed) and [packed[a:b] for a, b in zip([0, *ends], ends)] == [v.codes[v[w]] for w in words]
    assert len({v.codes[v[w]] for w in words}) == len(words)


# long lists of parts


def test_secrets_of_a_long_checksum_list(spark):
    """Twice the parts take about twice the time: 200,000 lines of checksums in one text end in time, scopes and all."""
    import time

    from lumenframe.llm import secret_scan

    lines = [hashlib.md5(str(i).encode()).hexdigest() + ("\n" if i % 50 == 0 else "") for i in range(200_000)]
    text = "\n".join(lines) + "\n\nclient_id: abcdef12\n" + "0" * 31 + "g\n"
    began = time.time()
    got = secret_scan.scan(docs(spark, [text, "", None, "client_id=abcdef12 " + "f" * 32])).collect()
    assert time.time() - began < 60
    sizes = {r["id"]: (len(r["base"]), len(r["spans"])) for r in got}
    assert sizes == {0: (200_000, 200_000), 1: (0, 0), 2: (0, 0), None: (1, 2)}


# near duplicates of short texts


def test_no_link_of_short_texts_is_lost(spark):
    """All pairs of texts of 5 to 12 words: whatever their fingerprints, those at a similarity of 0.8 are linked."""
    from lumenframe.llm import jaccard_dedup

    pick, texts = random.Random(3), []
    for k in range(700):
        words = [f"v{pick.randrange(10**6)}" for _ in range(pick.randint(5, 12))]
        texts += [" ".join(words), " ".join(words[:-1]) if k % 3 else " ".join([*words, "more"])]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            for j in by.setdefault(x, []):
                if len(s & sets[j]) >= 0.8 * len(s | sets[j]) - 1e-9:
                    a, b = label[i], label[j]
                    label = [min(a, b) if y in (a, b) else y for y in label]
            by[x].append(i)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    groups = {}
    for r in jaccard_dedup.near_duplicates(frame).collect():
        groups.setdefault(r["group"], []).append(r["id"])
    want = {}
    for i, x in enumerate(label):
        want.setdefault(x, []).append(i)
    assert sorted(map(sorted, groups.values())) == sorted(want.values()) and any(len(v) > 1 for v in want.values())


# license texts


def test_many_license_texts_in_one_document(spark):
    """A file of third parties' notices: 100 license texts in one document, with words of its own between them."""
    import time

    from lumenframe.llm import license_scan

    mit = license_scan.TEMPLATES["mit-text"]
    text = "\n".join(f"Component {i} all rights reserved\n{mit}\n" for i in range(100))
    began = time.time()
    got = license_scan.scan(docs(spark, [text, mit, mit.replace("granted", "given"), None])).collect()
    assert time.time() - began < 60
    labels = {r["id"]: (r["n_base"], r["labels"], r["score"]) for r in got}
    assert labels[0][0] == 100 and labels[0][2] == 1.0 and {"mit-notice", "mit-text", "reserved"} <= set(labels[0][1].split(","))
    assert labels[1][2] == 1.0 and 0.9 < labels[2][2] < 1 and labels[None] == (0, "", 0.0)

import hashlib
import random
import zlib
from collections import defaultdict

from tracklens.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, pos long, entry string, node string, depth int"


def rows(seed=1, n=80):
    """Conversations that share first turns, one that many repeat, and a very long one."""
    r = random.Random(seed)
    texts = ["", "hi", "x" * 3000, "é 漢字", None, "same", "a:b"]
    out = []
    for c in range(n):
        if c % 3 == 0:
            turns = [("user", "hot"), ("assistant", "answer"), ("user", "thanks")]
        else:
            turns = [(r.choice(["user", "assistant", None]), r.choice(texts)) for _ in range(r.randrange(1, 12))]
        out += [(c, i if c % 7 else 10 - i, *t) for i, t in enumerate(turns)]
    out += [(200, i, "user", f"turn {i % 5}") for i in range(300)]
    out += [(3, 0, "user", "hot"), (4, None, "u", "first"), (4, None, "u", "first"), (5, 2, "b", "tie"), (5, 2, "a", "tie"), (None, 1, "user", "nobody"), (10**12, 1, "user", "far")]
    r.shuffle(out)
    return out


def frame(spark, given):
    return spark.createDataFrame([(*g, 1, "e", "n", 2) for g in given], SCHEMA)


def ordered(given):
    convs = defaultdict(list)
    for c, turn, role, text in given:
        if c is not None:
            role, text = (role or "").encode(), (text or "").encode()
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(b"%d:" % len(role) + role + text).digest(), (role, text)))
    return {c: [t[3] for t in sorted(ts)] for c, ts in convs.items()}


def brute(convs):
    members = defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "RUN", 3)  # several runs for the ends of one node
    given = rows()
    assert got(T.trie(frame(spark, given))) == brute(ordered(given))


def rebuilt(convs):
    out = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + ts[h:]
    return out


def test_query_against_brute_force(spark, tmp_path):
    given = [g for g in rows(2) if g[0] != 0 and g[0] != 15]  # some beginnings are of conversations that aren't there
    frame(spark, given).write.parquet(str(tmp_path / "conversations.parquet"))
    want = rebuilt(ordered(given))
    assert any(not ts for ts in want.values())  # turnless ones too
    assert got(T.op11_prefix_trie(spark, str(tmp_path))) == brute(want)


def test_no_conversation(spark, tmp_path):
    frame(spark, [(None, 1, "a", "b")]).write.parquet(str(tmp_path / "conversations.parquet"))
    assert T.op11_prefix_trie(spark, str(tmp_path)).count() == 0


def test_role_and_text_are_kept_apart(spark):
    assert T.trie(frame(spark, [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "1:a", "b")])).count() == 4


def test_hot_node_is_spread_over_ranges(spark):
    given = [(c, 0, "user", "hot") for c in range(5000)]
    paths = T.stored(T.prefixes(T.starts(T.turns(frame(spark, given)))), "prefixes")
    ends = {bytes(r.node): r.ends_sha256 for r in T.ends(paths).collect()}
    assert list(ends.values()) == [hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()]

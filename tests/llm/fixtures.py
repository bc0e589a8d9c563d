"""A small table with every awkward case, and texts that share parts."""

import random

WORDS = [f"w{i}" for i in range(400)]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, id string, h string, at int, n int, score string, shard string, component string, size string"


def texts(seed=1, n=60):
    """Random texts, some with shared passages, near copies, copies and repeated lines."""
    r = random.Random(seed)
    some = lambda k: " ".join(r.choices(WORDS, k=k))
    passage, out = some(70), []
    for i in range(n):
        if i % 10 == 3:
            out.append(f"{some(30)} {passage} {some(25)}")
        elif i % 10 == 5 and out:
            words = r.choice(out).split()
            for _ in range(max(1, len(words) // 120)):
                if words:
                    words[r.randrange(len(words))] = "changed"
            out.append(" ".join(words))
        elif i % 10 == 7:
            out.append(r.choice(out))
        else:
            out.append("\n".join(some(r.randrange(5, 40)) for _ in range(r.randrange(1, 6))))
    return out


def documents(spark, empty=False):
    rows = [(i, t) for i, t in enumerate(texts())]
    long = " ".join(random.Random(2).choices(WORDS, k=20_000))
    rows += [(100, None), (101, ""), (102, " \t\n\x0b\x0c\r"), (103, long), (104, long), (105, "one"), (106, "One two"), (107, "é\u00a0ß 漢字 \u3000x"), (108, "a " * 300), (None, "null id " + rows[3][1])]
    rows += [rows[3], rows[4], (8, "another text of the same id " + rows[13][1])]
    full = [(i, t, None if (i or 0) % 13 == 5 else "en", None if (i or 0) % 17 == 6 else f"s{(i or 0) % 3}", None, 7, "x", "h", 1, 2, "s", "z", "c", "q") for i, t in rows]
    return spark.createDataFrame([] if empty else full, SCHEMA)


def columns(df):
    return [r.asDict() for r in df.collect()]

"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, and odd columns."""

import random
import re


def texts(seed=3, n=40):
    """(doc_id, text, lang) rows with shared passages, copies, near copies, nulls and odd white space."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    make = lambda k: [word() for _ in range(k)]
    passage = make(70)
    rows = []
    for i in range(n):
        body = make(rng.choice((0, 3, 30, 60, 200)))
        if i % 4 == 1:
            at = rng.randint(0, len(body))
            body[at:at] = passage[rng.randint(0, 5) : rng.randint(60, 70)]
        rows.append((i, " ".join(body), rng.choice(("xx", "yy", None))))
    rows += [(100 + i, rows[i][1], "xx") for i in (1, 5, 9)]
    near = rows[5][1].split()
    if near:
        near[0] = "changed"
    rows += [(120, " ".join(near), "xx"), (121, " ".join(make(30_000)), "yy"), (122, None, None), (123, None, "xx")]
    rows += [(124, "", "xx"), (125, " \t\n ", "xx"), (126, "one", "xx"), (127, "ONE", "xx"), (128, "  two words", "xx")]
    rows += [(None, rows[1][1], "xx"), (None, "only here", "xx"), rows[3], rows[3]]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id bigint, text string, lang string"


def frame(spark, rows=None):
    """The rows with extra columns whose names operators use inside."""
    found = spark.createDataFrame(texts() if rows is None else rows, SCHEMA)
    odd = "d k fp s v n h at kept words label score length bin item row"
    return found.selectExpr("*", *[f"'x' AS `{c}`" for c in odd.split()]).repartition(3)


def sent(df):
    """What lies below the broadcasts in the plan of ``df``, as one text for each broadcast."""
    found, open_ = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = re.match(r"[ :+|-]*", line).end()
        open_ = [(at, lines) for at, lines in open_ if at < depth]
        for _, lines in open_:
            lines.append(line)
        if "BroadcastExchange" in line:
            open_.append((depth, []))
            found.append(open_[-1][1])
    return ["\n".join(lines) for lines in found]

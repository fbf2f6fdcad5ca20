"""ANSI SQL for the queries, written independently of the Spark code."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

ORACLES: dict[str, str] = {}


def with_parts(parts: dict[str, str], body: str) -> str:
    """A WITH query from named, materialised steps."""
    steps = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in parts.items())
    return f"WITH {steps}\n{body}"


def unit(seed, *keys: str) -> str:
    text = ", ".join([f"'{seed}'", *keys])
    return f"(('0x' || substr(md5(concat_ws(':', {text})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def digest(seed, *keys: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
PURCHASES = """
SELECT p_type AS category, o_custkey::VARCHAR AS u, l_partkey::VARCHAR AS i,
       epoch(o_orderdate)::BIGINT AS ts, l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_extendedprice, l_discount AS overall
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
CLICKS = """
SELECT event_type AS category, user_id::VARCHAR AS u, json_extract_string(props, '$.k') AS i,
       epoch(date_trunc('second', ts))::BIGINT AS ts, event_id
FROM events"""


def core_parts(user_core: int, item_core: int, rounds: int = 12, source: str = "raw") -> dict[str, str]:
    """Simultaneous passes over users and items, unrolled; extra passes change nothing."""
    parts = {}
    before = source
    for r in range(rounds):
        parts[f"pass{r}"] = f"""
            SELECT * FROM {before}
            QUALIFY count(*) OVER (PARTITION BY category, u) >= {user_core}
                AND count(*) OVER (PARTITION BY category, i) >= {item_core}"""
        before = f"pass{r}"
    parts["core"] = f"SELECT * FROM {before}"
    return parts


STATS = """
SELECT c.category, coalesce(s.users, 0) AS users, coalesce(s.interactions, 0) AS interactions,
       coalesce(s.items, 0) AS items, round(s.interactions / s.users, 6) AS avg_len,
       round(coalesce((1 - s.interactions / (s.users::DOUBLE * s.items)) * 100, 0.0), 6) AS sparsity
FROM (SELECT DISTINCT category FROM raw) c
LEFT JOIN (SELECT category, count(DISTINCT u) AS users, count(DISTINCT i) AS items,
                  count(*) AS interactions FROM core GROUP BY category) s USING (category)"""

ROWS = 'category, u AS "user", i AS item, ts, l_orderkey, l_linenumber'

ORACLES["interaction_counts"] = with_parts(
    {"raw": PURCHASES},
    """SELECT 'user' AS side, category, u AS key, count(*) AS n FROM raw GROUP BY category, u
       UNION ALL SELECT 'item', category, i, count(*) FROM raw GROUP BY category, i""",
)
ORACLES["rating_filter"] = with_parts(
    {"raw": PURCHASES},
    f"SELECT {ROWS.replace('ts,', 'ts, overall,')} FROM raw WHERE overall > 0",
)
ORACLES["kcore_check"] = with_parts(
    {"raw": PURCHASES, "n": "SELECT min(cu) AS mu, min(ci) AS mi FROM (SELECT count(*) OVER (PARTITION BY category, u) AS cu, count(*) OVER (PARTITION BY category, i) AS ci FROM raw)"},
    """SELECT mu >= 5 AND mi >= 5 AS is_kcore, '5/5' AS cores FROM n
       UNION ALL SELECT mu >= 1 AND mi >= 1, '1/1' FROM n""",
)
ORACLES["kcore_pass"] = with_parts({"raw": PURCHASES, **core_parts(5, 20, 1)}, f"SELECT {ROWS} FROM core")
ORACLES["kcore_interactions"] = with_parts(
    {"raw": PURCHASES, **core_parts(5, 5)}, f"SELECT {ROWS} FROM core"
)
ORACLES["kcore_stats"] = with_parts({"raw": PURCHASES, **core_parts(5, 5)}, STATS)
ORACLES["kcore_many_rounds"] = with_parts(
    {"raw": f"SELECT * REPLACE ('all' AS category) FROM ({PURCHASES})", **core_parts(20, 20)}, STATS
)
ORACLES["kcore_empty"] = with_parts({"raw": PURCHASES, **core_parts(9, 28)}, STATS)


def sequenced(order: str, source: str = "raw") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY category, u ORDER BY ts, {order}) AS pos
               FROM {source}"""


LISTED = """
SELECT category, u AS "user", 0::BIGINT AS chunk_no, string_agg(i, ' ' ORDER BY pos) AS items
FROM seq GROUP BY category, u"""
ORACLES["user_sequences"] = with_parts({"raw": PURCHASES, "seq": sequenced(LINE_ORDER)}, LISTED)
ORACLES["event_sequences"] = with_parts({"raw": CLICKS, "seq": sequenced("event_id")}, LISTED)


def id_parts(order: str, source: str = "raw") -> dict[str, str]:
    return {
        "seq": sequenced(order, source),
        "uid": f"""SELECT category, u, row_number() OVER (PARTITION BY category
                   ORDER BY {digest(2022, 'category', 'u')}, u) AS user_id
                   FROM (SELECT DISTINCT category, u FROM {source})""",
        "enc0": "SELECT * FROM seq JOIN uid USING (category, u)",
        "iid": """SELECT category, i, row_number() OVER (PARTITION BY category ORDER BY user_id, pos) AS item_id
                  FROM (SELECT category, i, user_id, pos FROM enc0
                        QUALIFY row_number() OVER (PARTITION BY category, i ORDER BY user_id, pos) = 1)""",
        "enc": "SELECT category, user_id, pos, item_id FROM enc0 JOIN iid USING (category, i)",
    }


ALL_IDS = {"raw": PURCHASES, **id_parts(LINE_ORDER)}
CLICK_IDS = {"raw": CLICKS, **id_parts("event_id")}
CORE_IDS = {"raw": PURCHASES, **core_parts(5, 5), **id_parts(LINE_ORDER, "core")}

ORACLES["user_ids"] = with_parts(ALL_IDS, 'SELECT category, u AS "user", user_id FROM uid')
ORACLES["item_ids"] = with_parts(ALL_IDS, "SELECT category, i AS item, item_id FROM iid")
ORACLES["encoded_sequences"] = with_parts(ALL_IDS, "SELECT * FROM enc")
ORACLES["popularity"] = with_parts(
    CLICK_IDS,
    """SELECT category, item_id, n, round(n / sum(n) OVER (PARTITION BY category), 6) AS probability
       FROM (SELECT category, item_id, count(*) AS n FROM enc GROUP BY category, item_id)""",
)

# --- metadata and attributes ---
PRODUCTS = r"""
SELECT p_type AS category, p_partkey AS seq, p_partkey::VARCHAR AS asin,
       '  ' || replace(p_name, ' ', E' \n\t') || ' ' AS title,
       'A  ' || p_name || ' of size ' || p_size AS description,
       [['Products', p_type, 'Size ' || p_size], ['Products', p_brand]] AS categories,
       CASE WHEN p_size > 47 THEN NULL WHEN p_size < 4 THEN '' ELSE p_brand END AS brand
FROM part"""
VERSIONS = """
SELECT * FROM products
UNION ALL SELECT category, seq + 1000000000, asin, 'new ' || trim(title), description, categories, 'Renamed'
FROM products WHERE contains(description, 'red ')"""


def cleaned(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def normal(source: str, extra: str = "seq,") -> str:
    return f"""SELECT category, {extra} asin, {cleaned('title')} AS title, {cleaned('description')} AS description,
        array_to_string(list_transform(categories, lambda p: {cleaned("array_to_string(p, ' ')")}), '|') AS categories,
        CASE WHEN coalesce({cleaned('brand')}, '') = '' THEN '' ELSE 'Brand: ' || {cleaned('brand')} END AS details
        FROM {source}"""


META = {"products": PRODUCTS, "versions": VERSIONS}
ALLOWED = {"raw": PURCHASES, **core_parts(5, 28, 1), "allowed": "SELECT DISTINCT category, i AS asin FROM core"}
LATEST = """SELECT * FROM (SELECT *, min(seq) OVER (PARTITION BY category, asin) AS item_order FROM versions
            WHERE (category, asin) IN (SELECT category, asin FROM allowed))
            QUALIFY row_number() OVER (PARTITION BY category, asin ORDER BY seq DESC) = 1"""

ORACLES["aligned_items"] = with_parts(
    {**META, **ALLOWED}, normal("versions") + " WHERE (category, asin) IN (SELECT category, asin FROM allowed)"
)
ORACLES["meta_last_wins"] = with_parts(
    {**META, **ALLOWED, "latest": LATEST}, "SELECT category, asin, item_order, title, brand FROM latest"
)
KNOWN = {
    **META,
    **ALL_IDS,
    "allowed": "SELECT category, i AS asin FROM iid",
    "latest": LATEST,
    "listed": """SELECT category, asin, item_order,
        (CASE WHEN coalesce(brand, '') <> '' THEN [brand] ELSE [] END)
        || flatten(list_transform(categories, lambda p: p[2:])) AS a FROM latest""",
    "attrs": """SELECT category, asin, item_order, unnest(a) AS attribute,
        unnest(range(len(a)))::INTEGER AS pos FROM listed""",
}
FREQUENT = {
    "kept": "SELECT * FROM attrs QUALIFY count(*) OVER (PARTITION BY category, attribute) >= 8"
}
ORACLES["attribute_counts"] = with_parts(
    KNOWN, "SELECT category, attribute, count(*) AS n FROM attrs GROUP BY category, attribute"
)
ORACLES["attribute_floor"] = with_parts(
    {**KNOWN, **FREQUENT}, "SELECT category, asin, pos, attribute FROM kept"
)


def attribute_id_parts(source: str) -> dict[str, str]:
    return {
        "aid": f"""SELECT category, attribute, num, row_number() OVER (PARTITION BY category ORDER BY item_order, pos)
            AS attribute_id FROM (SELECT *, count(*) OVER (PARTITION BY category, attribute) AS num FROM {source}
            QUALIFY row_number() OVER (PARTITION BY category, attribute ORDER BY item_order, pos) = 1)""",
        "lists": f"""SELECT l.category, iid.item_id, string_agg(aid.attribute_id, ' ' ORDER BY k.pos) AS attribute_ids,
            count(aid.attribute_id) AS n
            FROM latest l JOIN iid ON iid.category = l.category AND iid.i = l.asin
            LEFT JOIN {source} k ON k.category = l.category AND k.asin = l.asin
            LEFT JOIN aid ON aid.category = k.category AND aid.attribute = k.attribute
            GROUP BY l.category, iid.item_id""",
    }


ATTRIBUTE_STATS = """SELECT category, coalesce(any_value(a.n), 0) AS attributes, round(coalesce(avg(l.n), 0.0), 6) AS avg_attributes,
              count(l.item_id) AS matched, count(*) AS items, round(count(l.item_id) / count(*), 6) AS match_ratio
       FROM iid LEFT JOIN lists l USING (category, item_id)
       LEFT JOIN (SELECT category, count(*) AS n FROM aid GROUP BY category) a USING (category)
       GROUP BY category"""
ATTRIBUTE_IDS = {**KNOWN, **attribute_id_parts("attrs")}
ORACLES["attribute_ids"] = with_parts(
    ATTRIBUTE_IDS, "SELECT category, attribute, attribute_id, num FROM aid"
)
ORACLES["item_attributes"] = with_parts(
    ATTRIBUTE_IDS, "SELECT category, item_id, coalesce(attribute_ids, '') AS attribute_ids FROM lists"
)
ORACLES["attribute_stats"] = with_parts(
    {**KNOWN, **FREQUENT, **attribute_id_parts("kept")},
    ATTRIBUTE_STATS,
)

# --- negatives ---


def slots_for(k: int) -> str:
    """Number of draws after which a user's remaining negatives are filled, by pool size."""
    first = k + k // 4 + 8
    cases = " ".join(f"WHEN n_items <= {first * 4 ** r} THEN {first * 4 ** r}" for r in range(6))
    return f"CASE {cases} END"


def negative_parts(k: int, mode: str) -> dict[str, str]:
    weight = "count(*)" if mode == "pop" else "1"
    return {
        "seen": "SELECT DISTINCT category, user_id, item_id FROM enc",
        "weights": f"SELECT category, item_id, {weight} AS w FROM enc GROUP BY category, item_id",
        "pool": """SELECT category, item_id, row_number() OVER (PARTITION BY category ORDER BY item_id, g) - 1 AS place
                   FROM (SELECT category, item_id, unnest(range(w)) AS g FROM weights)""",
        "sizes": """SELECT category, count(*) AS mass, count(DISTINCT item_id) AS n_items FROM pool GROUP BY category""",
        "draws": f"""SELECT category, user_id, slot, floor({unit(2022, 'category', 'user_id', 'slot')} * mass)::BIGINT AS place
                     FROM (SELECT category, user_id, mass, unnest(range({slots_for(k)})) AS slot
                           FROM (SELECT DISTINCT category, user_id FROM enc) JOIN sizes USING (category))""",
        "firsts": """SELECT category, user_id, item_id, min(slot) AS slot FROM draws JOIN pool USING (category, place)
                     GROUP BY category, user_id, item_id""",
        "candidates": f"""SELECT u.category, u.user_id, w.item_id, f.slot,
                       -ln(1 - {unit(2022, "'fill'", 'u.category', 'u.user_id', 'w.item_id')}) / w.w AS clock
                       FROM (SELECT DISTINCT category, user_id FROM enc) u
                       JOIN weights w ON w.category = u.category
                       LEFT JOIN firsts f ON f.category = u.category AND f.user_id = u.user_id AND f.item_id = w.item_id
                       WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.category = u.category
                                         AND s.user_id = u.user_id AND s.item_id = w.item_id)""",
        "neg": f"""SELECT category, user_id, item_id, row_number() OVER (PARTITION BY category, user_id
                   ORDER BY slot NULLS LAST, clock, item_id) AS neg_pos FROM candidates QUALIFY neg_pos <= {k}""",
    }


NEG = "SELECT category, user_id, neg_pos, item_id FROM neg"
ORACLES["negatives_random"] = with_parts({**CORE_IDS, **negative_parts(20, "random")}, NEG)
ORACLES["negatives_pop"] = with_parts({**CORE_IDS, **negative_parts(20, "pop")}, NEG)
ORACLES["negatives_short"] = with_parts({**CLICK_IDS, **negative_parts(99, "random")}, NEG)
ORACLES["negatives_short_pop"] = with_parts({**CLICK_IDS, **negative_parts(99, "pop")}, NEG)
ORACLES["unseen_items"] = with_parts(
    CLICK_IDS,
    """SELECT category, user_id, item_id % 100 + 1 AS item_id FROM enc e
       WHERE NOT EXISTS (SELECT 1 FROM enc s WHERE s.category = e.category AND s.user_id = e.user_id
                         AND s.item_id = e.item_id % 100 + 1)""",
)
LISTS = {
    "items_of": "SELECT category, user_id, string_agg(item_id, ' ' ORDER BY pos) AS item_ids FROM enc GROUP BY ALL",
    "neg_of": "SELECT category, user_id, string_agg(item_id, ' ' ORDER BY neg_pos) AS neg_items FROM neg GROUP BY ALL",
}
RECORDS = {**CORE_IDS, **negative_parts(20, "random"), **LISTS}
ORACLES["sequence_records"] = with_parts(
    RECORDS,
    """SELECT category, user_id, 0::BIGINT AS chunk_no, item_ids, coalesce(neg_items, '') AS neg_items
       FROM items_of LEFT JOIN neg_of USING (category, user_id)""",
)

ORACLES["sequence_records_chunked"] = f"SELECT * EXCLUDE (chunk_no) FROM ({ORACLES['sequence_records']})"

# --- shuffles and splits ---
PART_ROWS = "SELECT p_type AS category, p_partkey AS seq FROM part"


def split_parts(rows: str, key: str, n_eval: str, group: str = "", cap: int | None = None) -> dict[str, str]:
    """Rank by digest, cap, cut; ``n_eval`` is an expression over the capped total ``n``."""
    window = f"PARTITION BY {group}" if group else ""
    hashed = ", ".join(x for x in (group, key) if x)
    total = f"count(*) OVER ({window})"
    capped = f"least({total}, {cap})" if cap else total
    return {
        "placed": f"""SELECT *, row_number() OVER ({window} ORDER BY {digest(42, hashed)}, {key}) AS place,
                     {capped} AS n FROM ({rows})""",
        "sized": f"SELECT *, ({n_eval})::BIGINT AS n_eval FROM placed WHERE place <= n",
        "parted": """SELECT * EXCLUDE (place, n, n_eval), CASE WHEN place <= n_eval THEN 'eval' ELSE 'train' END AS split,
                     (place - 1 - CASE WHEN place <= n_eval THEN 0 ELSE n_eval END)::BIGINT AS "index" FROM sized""",
    }


UP = "ceil(0.02::DOUBLE * n)"
DOWN = "greatest(floor(n * 0.02::DOUBLE), 1)"
ORACLES["seeded_shuffle"] = f"""
SELECT category, seq, row_number() OVER (ORDER BY {digest(42, 'category', 'seq')}, category, seq) AS place
FROM ({PART_ROWS})"""
ORACLES["split_metadata"] = with_parts(
    split_parts(PART_ROWS, "category, seq", UP), "SELECT * FROM parted"
)
ORACLES["split_sequences"] = with_parts(
    split_parts("SELECT DISTINCT event_type AS category, user_id::VARCHAR AS u FROM events", "category, u", DOWN),
    'SELECT category, u AS "user", split, "index" FROM parted',
)
ORACLES["split_by_category"] = with_parts(
    split_parts(PART_ROWS, "seq", UP, "category"), "SELECT * FROM parted"
)
ORACLES["split_capped"] = with_parts(
    split_parts(PART_ROWS, "category, seq", "ceil(0.25::DOUBLE * n)", cap=150),
    """SELECT * FROM parted WHERE "index" < CASE WHEN split = 'train' THEN 100 ELSE 30 END""",
)

# --- product text and prompts ---
ORACLES["clean_text"] = f"SELECT doc_id, {cleaned('text')} AS cleaned FROM documents"
ORACLES["normalized_items"] = with_parts({"products": PRODUCTS}, normal("products"))
ORACLES["stringified"] = with_parts(
    {"products": PRODUCTS},
    r"""SELECT seq, concat(asin, ' ', regexp_replace(title, '^\s+|\s+$', '', 'g'), ' ',
        array_to_string(list_transform(categories, lambda p: array_to_string(p, ' ')), ' '), ' ',
        coalesce(brand, ''), ' ', seq) AS text FROM products""",
)
ORACLES["product_names"] = with_parts(
    {
        "t": f"""SELECT p_partkey AS seq,
            CASE WHEN p_size > 25 THEN p_name WHEN p_size > 15 THEN p_brand WHEN p_size > 5 THEN lower(p_type)
                 ELSE 'Unknown product' END AS product_name,
            {cleaned("p_name || '  ' || p_type")} AS features,
            {cleaned("p_name || '  ' || p_type")} AS description, p_brand AS categories FROM part"""
    },
    """SELECT seq, product_name, array_to_string(list_filter([features, CASE WHEN description <> features
       THEN description END, categories], lambda x: x IS NOT NULL), '|') AS features FROM t""",
)
TEXT_PARTS = {
    "products": PRODUCTS,
    "normal": normal("products"),
    **split_parts("SELECT * FROM normal", "category, seq", UP),
    "named": """SELECT seq, split, "index", title AS product_name,
        list_filter([description, details, replace(categories, '|', ' ')], lambda x: x <> '') AS f FROM parted""",
    "budget": f"""SELECT *, {unit('coin', '"index" + 42')} < 0.5 AS include,
        60 - length(product_name) - 12 AS left_over FROM named""",
    "texts": """SELECT seq, split, "index", product_name, CASE WHEN NOT include THEN product_name
        WHEN left_over - length(f[1]) <= 0 THEN product_name || '. Features: '
        WHEN left_over - length(f[1]) - 1 - length(f[2]) <= 0 THEN product_name || '. Features: ' || f[1]
        WHEN len(f) < 3 OR left_over - length(f[1]) - length(f[2]) - 2 - length(f[3]) <= 0
            THEN product_name || '. Features: ' || f[1] || ' ' || f[2]
        ELSE product_name || '. Features: ' || f[1] || ' ' || f[2] || ' ' || f[3] END AS product_text FROM budget""",
}
ORACLES["product_texts"] = with_parts(TEXT_PARTS, "SELECT * FROM texts")


def system_turn(size: int, code_range: int) -> str:
    return (
        "'system: You are a marketing analyst who specializes in product categorization and feature "
        f"extraction.Semantic-IDs are {size} integers that each value ranges from <|CODE_0|> to "
        f"<|CODE_{code_range}|>, separated by commands, and placed between <|bos_semantic|> and <|eos_semantic|>.'"
    )


def user_turn(index: str, text: str) -> str:
    return f"""'user: ' || CASE {index} % 5
        WHEN 0 THEN 'Please analyze the following product and its features: ' || {text} || '. Then, generate semantic-IDs that meaningfully represent the product.'
        WHEN 1 THEN 'Analyze this catalog item and convert it into semantic-IDs: ' || {text} || '.'
        WHEN 2 THEN 'Read the product information and map it to semantic-IDs for recommendation cold-start: ' || {text} || '.'
        WHEN 3 THEN 'Remember the following product and summarize it by generating semantic-IDs: ' || {text} || '.'
        ELSE 'Given the following product, produce semantic-IDs that capture its meaning: ' || {text} || '.' END"""


def code_slots(size: int) -> str:
    return "'The semantic-IDs are: <|bos_semantic|>' || repeat('<|eos_semantic|>', %d) || '<|eos_semantic|>'" % size


NL = "chr(10)"
OPEN = f"""{system_turn(6, 99)} || {NL} || {user_turn('"index"', 'product_text')}"""
ORACLES["prompt_records"] = with_parts(
    TEXT_PARTS,
    f"""SELECT seq, split, "index", {OPEN} || {NL} || 'assistant: ' || {code_slots(6)} AS guessing,
        {system_turn(6, 99)} || {NL} || 'user: ' || {code_slots(6)} || '. Recover the product name and/or its metadata.'
        || {NL} || 'assistant: The product name and/or its metadata are: ' || product_text AS reconstruction
        FROM texts""",
)
ORACLES["guessing_prompts"] = f"""
SELECT doc_id, {system_turn(4, 32)} || {NL} || {user_turn('7', 'text')} || {NL} || 'assistant: ' || {code_slots(4)} AS prompt
FROM documents"""
ORACLES["prompt_parts"] = with_parts(
    TEXT_PARTS,
    f"""SELECT seq, 'The product name and/or its metadata are: ' || product_text AS reference, {OPEN} AS open FROM texts""",
)

# --- code text ---
DRAWN = [f"floor({unit(7, 'vec_id', str(p))} * 17)::INTEGER - 1" for p in range(3)]
CODES = f"""SELECT 'label' || label AS category, vec_id, vec_id // 50 AS batch_id,
            [{', '.join(DRAWN)}] AS ids FROM embeddings"""
ORACLES["format_ids"] = f"""
SELECT vec_id, '<|bos_semantic|>' || array_to_string(ids, ',') || '<|eos_semantic|>' AS text FROM ({CODES})"""
TOKENS = "array_to_string(list_transform(ids, lambda c: CASE WHEN c >= 0 THEN '<|CODE_' || c || '|>' ELSE 'null' END), ' ')"
ORACLES["code_tokens"] = f"SELECT vec_id, {TOKENS} AS tokens FROM ({CODES})"


def parsed(text: str, size: int, top: int, fallback: str) -> str:
    return rf"""array_to_string((list_transform(
        list_concat(list_transform(regexp_extract_all({text}, '\d+'), lambda x: coalesce(try_cast(x AS HUGEINT), {top})), {fallback}),
        lambda v: greatest(1, least({top}, v))) || [{', '.join(['1'] * size)}])[1:{size}], ',')"""


ORACLES["parse_ids"] = f"""
SELECT doc_id, {parsed('text', 6, 99, '[n_chars::HUGEINT, 5::HUGEINT]')} AS ids FROM documents"""
ORACLES["parse_formatted"] = f"""
SELECT vec_id, {parsed("array_to_string(ids, ',')", 4, 12, '[]::HUGEINT[]')} AS ids FROM ({CODES})"""
ORACLES["code_lookup"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_transform([0, 1, 2], lambda p:
    CASE WHEN (l_partkey * 7 + l_suppkey * p + l_linenumber) % 40 < 32
          AND (l_partkey * 7 + l_suppkey * p + l_linenumber) % 2 = 0
         THEN (l_partkey * 7 + l_suppkey * p + l_linenumber) % 40 // 2 ELSE -1 END), ',') AS ids
FROM lineitem"""

# --- codebook quality ---


def quality(codes: str, columns: str = "*", extra: str = "max_sharing", group: str = "category") -> str:
    """Metrics from item rows, with the textbook entropy formula."""
    by = f"GROUP BY {group}"
    shown = f"{columns}" if columns != "*" else group
    return f"""
    SELECT {shown}, round(coalesce(exp(h), 0.0), 6) AS codebook_perplexity, coalesce(active, 0) AS active_codes,
           16 - coalesce(active, 0) AS dead_codes, round(coalesce(active, 0) / 16, 6) AS active_code_ratio,
           round(CASE WHEN active > 0 THEN collided / items ELSE 0.0 END, 6) AS collision_rate,
           round(CASE WHEN active > 0 THEN tuples / items ELSE 0.0 END, 6) AS uniqueness,
           CASE WHEN active > 0 THEN tuples ELSE 0 END AS num_unique_ids, items AS num_items
           {', max_sharing' if extra else ''}
    FROM (SELECT {group}, count(*) AS tuples, sum(c)::BIGINT AS items, coalesce(sum(c) FILTER (c > 1), 0) AS collided,
                 max(c) AS max_sharing FROM (SELECT {group}, ids, count(*) AS c FROM ({codes}) GROUP BY {group}, ids) {by}) t
    LEFT JOIN (SELECT {group}, -sum(p * ln(p)) AS h, count(*) AS active FROM (
                 SELECT {group}, code, count(*) / sum(count(*)) OVER (PARTITION BY {group}) AS p
                 FROM (SELECT {group}, unnest(ids) AS code FROM ({codes})) WHERE code >= 0 GROUP BY {group}, code) {by}) u
    USING ({group})"""


EVERY = "SELECT * REPLACE ('*' AS category) FROM ({})"
BOTH = f"SELECT category, ids FROM ({CODES}) UNION ALL SELECT '*', ids FROM ({CODES})"
PAIRS_OF = f"SELECT category, ids[1:2] AS ids FROM ({BOTH})"
ORACLES["codebook_quality"] = quality(EVERY.format(CODES))
ORACLES["quality_by_category"] = quality(BOTH)
ORACLES["quality_unknown"] = quality(f"SELECT category, [-1, -1, -1] AS ids FROM ({CODES})")
METRIC_NAMES = (
    "codebook_perplexity", "active_codes", "dead_codes", "active_code_ratio",
    "collision_rate", "uniqueness", "num_unique_ids", "num_items",
)
TEXT_NAMES = ("recon_exact_match", "recon_token_f1", "recon_rouge_l")


def in_file(sql: str, names: tuple[str, ...] = METRIC_NAMES) -> str:
    """Metrics under the names that files use."""
    return "SELECT " + ", ".join(f'{n} AS "eval/{n}"' for n in names) + f" FROM ({sql})"


ORACLES["quality_capped"] = quality(
    f"""SELECT '*' AS category, ids[1:2] AS ids FROM (SELECT *, row_number() OVER (ORDER BY {digest(42, 'vec_id')}, vec_id)
        AS place FROM ({CODES})) WHERE place < 300"""
)
ORACLES["quality_capped"] = in_file(ORACLES["quality_capped"])
ORACLES["collapse_histogram"] = f"""
SELECT category, n AS sharing, count(*) AS num_tuples
FROM (SELECT category, ids, count(*) AS n FROM ({PAIRS_OF}) GROUP BY ALL) GROUP BY category, n"""
ORACLES["most_shared"] = f"""
SELECT category, array_to_string(ids, ',') AS ids, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, ids) AS place
FROM (SELECT category, ids, count(*) AS n FROM ({PAIRS_OF}) GROUP BY ALL) QUALIFY place <= 20"""
POSITION_ROWS = "SELECT category, unnest([0, 1, 2]) AS pos, unnest(ids) AS code FROM ({})"
ORACLES["position_histogram"] = f"""
SELECT category, pos, code, count(*) AS n FROM ({POSITION_ROWS.format(BOTH)}) GROUP BY ALL"""
ORACLES["position_bars"] = f"""
SELECT a.category, a.pos, a.code, count(b.code) AS n
FROM (SELECT * FROM (SELECT DISTINCT 'label' || label AS category FROM embeddings),
      (SELECT unnest([0, 1, 2]) AS pos), (SELECT unnest(range(16))::INTEGER AS code)) a
LEFT JOIN ({POSITION_ROWS.format(CODES)}) b ON a.category = b.category AND a.pos = b.pos AND a.code = b.code
GROUP BY ALL"""
ORACLES["distinct_tuples"] = f"""
SELECT category, array_to_string(ids, ',') AS ids, count(*) AS n FROM ({CODES}) GROUP BY ALL"""
ORACLES["batch_health"] = f"""
SELECT batch_id, num_items, perplexity, diversity, uniqueness FROM (
    SELECT batch_id, count(*) AS num_items, round(count(DISTINCT ids[1:2]) / count(*), 6) AS uniqueness
    FROM ({CODES}) GROUP BY batch_id) LEFT JOIN (
    SELECT batch_id, round(exp(-sum(p * ln(p))), 6) AS perplexity, round(count(*) / 16, 6) AS diversity FROM (
        SELECT batch_id, code, count(*) / sum(count(*)) OVER (PARTITION BY batch_id) AS p
        FROM (SELECT batch_id, unnest(ids) AS code FROM ({CODES})) WHERE code >= 0 GROUP BY batch_id, code)
    GROUP BY batch_id) USING (batch_id)"""
ORACLES["batch_position_perplexity"] = f"""
SELECT batch_id, pos, round(exp(-sum(p * ln(p))), 6) AS perplexity FROM (
    SELECT batch_id, pos, code, count(*) / sum(count(*)) OVER (PARTITION BY batch_id, pos) AS p
    FROM (SELECT batch_id, unnest([0, 1, 2]) AS pos, unnest(ids) AS code FROM ({CODES}))
    WHERE code >= 0 GROUP BY batch_id, pos, code) GROUP BY batch_id, pos"""

# --- text fidelity ---
PREFIX = "The product name and/or its metadata are: "
COPIES = f"""
SELECT doc_id, text AS reference, CASE lang
    WHEN 'en' THEN translate(replace(text, ' ', '  '), '{ascii_lowercase}', '{ascii_uppercase}')
    WHEN 'de' THEN E' \\n' || '{PREFIX}' || text
    WHEN 'fr' THEN regexp_replace(text, '[ai]n', 'on', 'g') ELSE text END AS prediction FROM documents"""
TURNS = """
SELECT a.conv_id, a.turn, a.text AS prediction, b.text AS reference
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""


def answer(text: str) -> str:
    bare = rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"
    cut = f"CASE WHEN starts_with({bare}, '{PREFIX}') THEN substr({bare}, {len(PREFIX) + 1}) ELSE {bare} END"
    return f"lower({cleaned(cut)})"


def word_parts(pairs: str, key: str) -> dict[str, str]:
    words = "CASE WHEN {0} = '' THEN [] ELSE string_split({0}, ' ') END"
    return {
        "pairs": f"SELECT {key}, {answer('prediction')} AS p, {answer('reference')} AS r FROM ({pairs})",
        "words": f"SELECT {key}, p, r, {words.format('p')} AS pw, {words.format('r')} AS rw FROM pairs",
        "p_counts": f"SELECT {key}, w, count(*) AS c FROM (SELECT {key}, unnest(pw) AS w FROM words) GROUP BY ALL",
        "r_counts": f"SELECT {key}, w, count(*) AS d FROM (SELECT {key}, unnest(rw) AS w FROM words) GROUP BY ALL",
        "overlap": f"SELECT {key}, sum(least(c, d)) AS common FROM p_counts JOIN r_counts USING ({key}, w) GROUP BY ALL",
    }


def f1(common: str) -> str:
    return f"""CASE WHEN len(pw) = 0 AND len(rw) = 0 THEN 1.0 WHEN coalesce({common}, 0) = 0 THEN 0.0
               ELSE 2.0 * ({common} / len(pw)) * ({common} / len(rw)) / ({common} / len(pw) + {common} / len(rw)) END"""


# Row i of the table of common-subsequence lengths is the running maximum, over the words of the
# reference, of (previous row, or the previous row's left neighbour plus one on a match).
LCS_PARTS = {
    "grid": "SELECT conv_id, turn, pw, unnest(rw) AS w, unnest(range(len(rw))) AS j FROM words",
    "walk": """SELECT * FROM (WITH RECURSIVE step AS (
            SELECT conv_id, turn, j, 0 AS i, 0::BIGINT AS v FROM grid
            UNION ALL
            SELECT conv_id, turn, j, i + 1, max(c) OVER (PARTITION BY conv_id, turn ORDER BY j) FROM (
                SELECT s.conv_id, s.turn, s.j, s.i, CASE WHEN g.w = g.pw[s.i + 1]
                    THEN 1 + coalesce(lag(s.v) OVER (PARTITION BY s.conv_id, s.turn ORDER BY s.j), 0) ELSE s.v END AS c
                FROM step s JOIN grid g ON g.conv_id = s.conv_id AND g.turn = s.turn AND g.j = s.j
                WHERE s.i < len(g.pw)))
        SELECT conv_id, turn, max(v) AS lcs FROM step GROUP BY conv_id, turn)""",
}
ORACLES["answer_tokens"] = with_parts(
    word_parts(COPIES, "doc_id"), "SELECT doc_id, p AS normal, len(pw)::INTEGER AS tokens FROM words"
)
ORACLES["recon_exact"] = with_parts(
    word_parts(COPIES, "doc_id"), "SELECT doc_id, (p = r)::INTEGER::DOUBLE AS recon_exact_match FROM words"
)
ORACLES["recon_token_f1"] = with_parts(
    word_parts(COPIES, "doc_id"),
    f"SELECT doc_id, round({f1('common')}, 6) AS recon_token_f1 FROM words LEFT JOIN overlap USING (doc_id)",
)
TURN_PARTS = {**word_parts(TURNS, "conv_id, turn"), **LCS_PARTS}
ORACLES["recon_rouge_l"] = with_parts(
    TURN_PARTS,
    f"""SELECT conv_id, turn, round({f1('lcs')}, 6) AS recon_rouge_l
        FROM words LEFT JOIN walk USING (conv_id, turn)""",
)
MEANS = f"""SELECT round(coalesce(avg((p = r)::INTEGER), 0.0), 6) AS recon_exact_match,
    round(coalesce(avg({f1('common')}), 0.0), 6) AS recon_token_f1, round(coalesce(avg({f1('lcs')}), 0.0), 6) AS recon_rouge_l
    FROM words LEFT JOIN overlap USING (conv_id, turn) LEFT JOIN walk USING (conv_id, turn)"""
ORACLES["recon_summary"] = with_parts(TURN_PARTS, MEANS)
ORACLES["recon_examples"] = f"SELECT doc_id, prediction, reference FROM ({COPIES}) ORDER BY doc_id LIMIT 5"
REPORT = f"SELECT q.* EXCLUDE (category, max_sharing), m.* FROM ({quality(EVERY.format(CODES))}) q, ({MEANS}) m"
ORACLES["rec_report"] = in_file(with_parts(TURN_PARTS, REPORT), METRIC_NAMES + TEXT_NAMES)

# --- sources and sinks ---
SURVIVING = "NOT ends_with(description, 'size 17')"
ORACLES["split_layout_free"] = """
SELECT count(*) AS rows, ceil(0.25 * count(*))::BIGINT AS evals, 0::BIGINT AS differing FROM part"""
ORACLES["file_order_ties"] = """
SELECT p_partkey || ' ' || p_name AS value, pieces,
       row_number() OVER (PARTITION BY pieces ORDER BY CASE WHEN p_size < 5 THEN 0 WHEN p_size < 40 THEN 1 ELSE 2 END, p_partkey) AS pos
FROM part, (SELECT unnest(['small', 'large']) AS pieces)"""
ORACLES["loose_dict_scan"] = with_parts(
    {"products": PRODUCTS},
    f"""SELECT category, asin, title, description, brand,
        array_to_string(list_transform(categories, lambda p: array_to_string(p, '>')), '|') AS categories
        FROM products WHERE {SURVIVING}""",
)
ORACLES["loose_reviews"] = with_parts(
    {"raw": PURCHASES},
    'SELECT category, u AS "user", i AS item, ts, count(*) AS n FROM raw WHERE overall > 0 GROUP BY ALL',
)
ORACLES["structured_scan"] = with_parts(
    {"products": PRODUCTS},
    f"""SELECT category, {cleaned('title')} AS product_name, array_to_string(list_filter(
        [asin, {cleaned('description')}, coalesce(brand, ''), category], lambda x: x <> ''), '|') AS features FROM products""",
)
ORACLES["text_inputs"] = """
SELECT product_text, count(*) AS n, bool_or(f) AS comes_first
FROM (SELECT p_name AS product_text, false AS f FROM part UNION ALL SELECT 'Wireless mouse ', true) GROUP BY product_text"""
ORACLES["artifact_sequences"] = with_parts(
    {**CORE_IDS, **{"items_of": LISTS["items_of"]}},
    "SELECT category, user_id::VARCHAR AS user_id, 0::BIGINT AS chunk_no, item_ids FROM items_of",
)
ORACLES["artifact_category_folders"] = ORACLES["artifact_sequences"]
ORACLES["artifact_negatives"] = with_parts(
    RECORDS, "SELECT category, user_id::VARCHAR AS user_id, 0::BIGINT AS chunk_no, neg_items FROM neg_of"
)
ORACLES["artifact_item_ids"] = with_parts(CORE_IDS, "SELECT category, i AS item, item_id FROM iid")
CORE_ATTRIBUTES = {
    **META, **CORE_IDS, "allowed": KNOWN["allowed"], "latest": LATEST, "listed": KNOWN["listed"],
    "attrs": KNOWN["attrs"], **attribute_id_parts("attrs"),
}
ORACLES["artifact_item_attributes"] = with_parts(
    CORE_ATTRIBUTES, "SELECT category, item_id, coalesce(attribute_ids, '') AS attribute_ids FROM lists"
)
ORACLES["artifact_id_maps"] = with_parts(
    CORE_ATTRIBUTES,
    """SELECT category, 'user2id' AS map, u AS key, user_id::VARCHAR AS value FROM uid
       UNION ALL SELECT category, 'id2user', user_id::VARCHAR, u FROM uid
       UNION ALL SELECT category, 'item2id', i, item_id::VARCHAR FROM iid
       UNION ALL SELECT category, 'id2item', item_id::VARCHAR, i FROM iid
       UNION ALL SELECT category, 'attribute2id', attribute, attribute_id::VARCHAR FROM aid
       UNION ALL SELECT category, 'id2attribute', attribute_id::VARCHAR, attribute FROM aid
       UNION ALL SELECT category, 'attributeid2num', attribute_id::VARCHAR, num::VARCHAR FROM aid""",
)
ORACLES["preprocess_run"] = with_parts(
    CORE_ATTRIBUTES,
    f"""SELECT s.*, a.attributes, a.avg_attributes, a.matched, a.match_ratio, n.negatives
        FROM ({STATS}) s JOIN ({ATTRIBUTE_STATS}) a USING (category)
        JOIN (SELECT category, sum(least(5, n_items - own))::BIGINT AS negatives
              FROM (SELECT category, user_id, count(DISTINCT item_id) AS own FROM enc GROUP BY ALL)
              JOIN (SELECT category, count(*) AS n_items FROM iid GROUP BY category) USING (category)
              GROUP BY category) n USING (category)""",
)
ORACLES["sequence_corpus"] = with_parts(
    {**RECORDS, **split_parts("SELECT DISTINCT category, user_id::VARCHAR AS user_id FROM enc", "category, user_id", DOWN)},
    """SELECT category, user_id, 0::BIGINT AS chunk_no, item_ids, coalesce(neg_items, '') AS neg_items, split, "index"
       FROM (SELECT * REPLACE (user_id::VARCHAR AS user_id) FROM items_of LEFT JOIN neg_of USING (category, user_id))
       JOIN parted USING (category, user_id)""",
)
ORACLES["item_corpus"] = with_parts(
    {**META, **CORE_IDS, "allowed": KNOWN["allowed"]},
    normal("products", "") + f" WHERE {SURVIVING} AND (category, asin) IN (SELECT category, asin FROM allowed)",
)
ORACLES["metrics_json"] = in_file(ORACLES["codebook_quality"])
ORACLES["rec_metrics_json"] = ORACLES["rec_report"]
REPORT_CODES = f"SELECT category, ids[1:2] AS ids FROM ({CODES})"
REPORT_BOTH = f"SELECT * FROM ({REPORT_CODES}) UNION ALL SELECT '*', ids FROM ({REPORT_CODES})"
ORACLES["report_json"] = f"""
SELECT q.*, h.histogram_bars, s.top_count, s.top_tuple, p.first_position_codes
FROM ({quality(REPORT_BOTH)}) q
JOIN (SELECT category, count(DISTINCT n)::INTEGER AS histogram_bars FROM
      (SELECT category, ids, count(*) AS n FROM ({REPORT_BOTH}) GROUP BY ALL) GROUP BY category) h USING (category)
JOIN (SELECT category, n AS top_count, array_to_string(ids, ',') AS top_tuple FROM
      (SELECT category, ids, count(*) AS n FROM ({REPORT_BOTH}) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, ids) = 1) s USING (category)
JOIN (SELECT category, count(DISTINCT ids[1])::INTEGER AS first_position_codes FROM ({REPORT_BOTH}) GROUP BY category) p
USING (category)
UNION ALL BY NAME
SELECT 'absent' AS category, 0.0 AS codebook_perplexity, 0 AS active_codes, 16 AS dead_codes, 0.0 AS active_code_ratio,
       0.0 AS collision_rate, 0.0 AS uniqueness, 0 AS num_unique_ids, 0 AS num_items, 0 AS max_sharing, 0 AS histogram_bars,
       0 AS first_position_codes"""
ORACLES["assignments_jsonl"] = f"""
SELECT category || '-' || vec_id AS product_name, array_to_string(ids, ',') AS ids, {TOKENS} AS tokens FROM ({CODES})"""

# --- codes for items ---
PROMPT = """'[{"m":"' || md5(text) || '"}]'"""
HASHED = ", ".join(
    f"('0x' || substr(md5('{p}:' || {PROMPT}), 1, 6))::BIGINT % 18" for p in range(3)
)
GENERATED = f"""SELECT conv_id, turn, text, array_to_string(list_transform([{HASHED}],
    lambda c: CASE WHEN c < 16 THEN c ELSE -1 END), ',') AS ids FROM conversations"""
ORACLES["batch_apply"] = f"""
SELECT conv_id, turn, ids, '<|bos_semantic|>' || ids || '<|eos_semantic|>' AS semantic_id_text FROM ({GENERATED})"""
ORACLES["generated_jsonl"] = f"""
SELECT text AS product_text, ids, '<|bos_semantic|>' || ids || '<|eos_semantic|>' AS semantic_id_text, count(*) AS n
FROM ({GENERATED}) GROUP BY ALL"""


def book_sql(source: str) -> str:
    return f"""SELECT label AS code, list(m ORDER BY dim) AS c FROM (
        SELECT label, dim, round(avg(x::DECIMAL(38, 18)), 6)::DOUBLE AS m FROM (
            SELECT label, unnest(v) AS x, unnest(range(len(v))) AS dim FROM {source}) GROUP BY label, dim) GROUP BY label"""


def nearest_sql(source: str, book: str) -> str:
    return f"""SELECT vec_id, label, e, code, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS v FROM (
        SELECT s.*, b.code, b.c, row_number() OVER (PARTITION BY vec_id ORDER BY
            list_sum(list_transform(list_zip(s.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.code) AS k
        FROM {source} s, {book} b) WHERE k = 1"""


VECTOR_PARTS = {
    "v0": "SELECT vec_id, label, embedding::DOUBLE[] AS e, embedding::DOUBLE[] AS v FROM embeddings",
    "book0": book_sql("v0"),
    "v1": nearest_sql("v0", "book0"),
    "book1": book_sql("v1"),
    "v2": nearest_sql("(SELECT vec_id, label, e, v FROM v1)", "book1"),
}
ORACLES["residual_codes"] = with_parts(
    VECTOR_PARTS, "SELECT vec_id, v1.code || ',' || v2.code AS ids FROM v1 JOIN v2 USING (vec_id)"
)
ORACLES["residual_codes_nulls"] = f"""
SELECT vec_id, CASE WHEN vec_id % 7 > 0 THEN ids END AS ids FROM ({ORACLES['residual_codes']})"""
ORACLES["codebook_fit"] = """
SELECT level::INTEGER AS level, count(*) AS items, true AS error_falls, true AS known_codes, 8::BIGINT AS codes
FROM embeddings, (SELECT unnest([0, 1]) AS level) GROUP BY level"""
ORACLES["residual_error"] = with_parts(
    {**VECTOR_PARTS, "rebuilt_v": "SELECT *, list_transform(list_zip(e, v), lambda z: z[1] - z[2]) AS rebuilt FROM v2"},
    """SELECT vec_id, round(list_dot_product(v, v), 6) AS squared_error,
              round(list_cosine_similarity(e, rebuilt), 6) AS cosine FROM rebuilt_v""",
)
ORACLES["decoded_vectors"] = with_parts(
    {**VECTOR_PARTS, "rebuilt_v": "SELECT vec_id, list_transform(list_zip(e, v), lambda z: z[1] - z[2]) AS rebuilt FROM v2"},
    "SELECT vec_id, round(list_dot_product(rebuilt, rebuilt), 6) AS norm2 FROM rebuilt_v",
)

CORPUS_SIDES = """
SELECT side AS split, records, 0::BIGINT AS first, records - 1 AS last, records AS indexes, records AS prompts
FROM (SELECT unnest(['train', 'eval']) AS side, unnest([n - e, e]) AS records
      FROM (SELECT n, ceil({0} * n)::BIGINT AS e FROM (SELECT count(*) AS n FROM ({1})))) WHERE records > 0"""
ORACLES["loose_corpus"] = CORPUS_SIDES.format(0.02, ORACLES["item_corpus"])
ORACLES["structured_corpus"] = CORPUS_SIDES.format(0.2, "SELECT * FROM part")
ORACLES["preprocess_files_run"] = with_parts(
    {
        "raw": f"SELECT * REPLACE ('all' AS category) FROM ({PURCHASES}) WHERE overall > 0",
        **core_parts(5, 5),
        "own": "SELECT u, count(*) AS c, count(DISTINCT i) AS d FROM core GROUP BY u",
        "pool": "SELECT count(DISTINCT i) AS items FROM core",
    },
    """SELECT 'users' AS what, count(*) AS n FROM own UNION ALL SELECT 'interactions', sum(c)::BIGINT FROM own
       UNION ALL SELECT 'items', items FROM pool UNION ALL SELECT 'described', items FROM pool
       UNION ALL SELECT 'negatives', sum(least(5, items - d))::BIGINT FROM own, pool""",
)
ORACLES["sparse_code_lookup"] = f"SELECT vec_id, array_to_string(ids, ',') AS ids FROM ({CODES})"
ORACLES["kcore_buckets"] = ORACLES["kcore_many_rounds"]
ORACLES["accumulated_quality"] = ORACLES["quality_by_category"]
ORACLES["residual_codes_far"] = ORACLES["residual_codes"]
ORACLES["codebook_loads"] = """
SELECT level::INTEGER AS level, count(*) AS items, 96::BIGINT AS used_codes
FROM embeddings, (SELECT unnest([0, 1]) AS level) GROUP BY level"""

# --- recommendation lists, baselines and collisions ---
SUPPLIER_LINES = """SELECT o_custkey AS u, l_suppkey AS i, l_quantity, year(o_orderdate) >= 1996 AS late
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def ranking_parts(lists: dict[str, str], cutoffs: tuple[int, ...]) -> dict[str, str]:
    """Per user and K, from ``scores`` (g, u, i, s) and ``gains`` (g, u, i, w), each item once."""
    return {
        **lists,
        "placed": "SELECT *, row_number() OVER (PARTITION BY g, u ORDER BY s DESC, i) AS p FROM scores",
        "hits": "SELECT g, u, p, w FROM placed JOIN gains USING (g, u, i)",
        "best": "SELECT *, row_number() OVER (PARTITION BY g, u ORDER BY w DESC, i) AS p FROM gains",
        "cuts": f"SELECT unnest({list(cutoffs)}) AS k",
        "judged": "SELECT g, u, count(*) AS n_relevant FROM gains GROUP BY g, u",
        "found": """SELECT g, u, k, count(p) FILTER (p <= k) AS n, sum(w / log2(1 + p)) FILTER (p <= k) AS dcg, min(p) AS first
            FROM judged CROSS JOIN cuts LEFT JOIN hits USING (g, u) GROUP BY g, u, k""",
        "most": "SELECT g, u, k, sum(w / log2(1 + p)) AS idcg FROM best JOIN cuts ON p <= k GROUP BY g, u, k",
        "each_user": """SELECT g, u, k, n_relevant, n / n_relevant AS recall, (n > 0)::INTEGER::DOUBLE AS hit,
            coalesce(dcg, 0.0) / idcg AS ndcg, coalesce(1.0 / first, 0.0) AS mrr
            FROM found JOIN most USING (g, u, k) JOIN judged USING (g, u)""",
    }


SUPPLIER_LISTS = {
    "rows": SUPPLIER_LINES,
    "scores": "SELECT 0 AS g, u, i, sum(l_quantity) AS s FROM rows WHERE NOT late GROUP BY u, i",
    "gains": "SELECT 0 AS g, u, i, count(*) AS w FROM rows WHERE late GROUP BY u, i",
}
RANKING = """SELECT {0} k::INTEGER AS k, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(ndcg), 6) AS ndcg,
    round(avg(mrr), 6) AS mrr, count(*) AS num_users, coalesce(any_value(unjudged), 0) AS num_unjudged
    FROM each_user LEFT JOIN (SELECT g, count(DISTINCT u) AS unjudged FROM scores ANTI JOIN judged USING (g, u) GROUP BY g)
    USING (g) GROUP BY g, k"""
ORACLES["ranking_metrics"] = with_parts(ranking_parts(SUPPLIER_LISTS, (5, 10, 50, 100)), RANKING.format(""))
SHOWN = ", ".join(f"round(max({m}) FILTER (k = {k}), 6) AS {m}_{k}" for k in (5, 10) for m in ("recall", "hit", "ndcg"))
ORACLES["ranking_per_user"] = with_parts(
    ranking_parts(SUPPLIER_LISTS, (5, 10)),
    f'SELECT u AS "user", any_value(n_relevant) AS n_relevant, round(max(mrr), 6) AS mrr, {SHOWN} FROM each_user GROUP BY u',
)
CLICK_LISTS = {
    "rows": """SELECT event_type AS g, user_id AS u, json_extract_string(props, '$.k')::INTEGER AS i,
               floor(value / 4) AS s, hour(ts) >= 20 AS night FROM events""",
    "scores": "SELECT g, u, i, max(s) AS s FROM rows WHERE NOT night GROUP BY g, u, i",
    "gains": "SELECT g, u, i, 1.0::DOUBLE AS w FROM rows WHERE night GROUP BY g, u, i",
}
ORACLES["ranking_by_category"] = with_parts(
    ranking_parts(CLICK_LISTS, (5, 10, 50, 100)), RANKING.format("g AS category,")
)


def prefixes_of(rows: str, size: int) -> str:
    return f"""SELECT *, array_to_string(ids[1:length], ',') AS prefix
               FROM (SELECT *, unnest(range(1, {size + 1}))::INTEGER AS length FROM ({rows}))"""


def purity_sql(rows: str, label: str, size: int) -> str:
    return f"""SELECT length, prefix, sum(c)::BIGINT AS n, count(*) AS n_labels, max(share) AS purity,
                      -sum(share * ln(share)) AS entropy
        FROM (SELECT length, prefix, {label}, count(*) AS c,
                     count(*) / sum(count(*)) OVER (PARTITION BY length, prefix) AS share
              FROM ({prefixes_of(rows, size)}) GROUP BY length, prefix, {label}) GROUP BY length, prefix"""


ORACLES["prefix_purity"] = f"""
SELECT length, prefix, n, n_labels, round(purity, 6) AS purity, round(entropy, 6) + 0.0 AS entropy
FROM ({purity_sql(CODES, 'category', 3)})"""
LEARNED = "SELECT vec_id, label, e, [v1.code, v2.code] AS ids FROM v1 JOIN (SELECT vec_id, code FROM v2) v2 USING (vec_id)"
ORACLES["prefix_purity_by_length"] = with_parts(
    {**VECTOR_PARTS, "learned": LEARNED},
    f"""SELECT length, count(*) AS num_prefixes, sum(n)::BIGINT AS num_items, max(n) AS largest,
        round(sum(n * purity) / sum(n), 6) AS purity, round(sum(n * entropy) / sum(n), 6) AS entropy
        FROM ({purity_sql('FROM learned', 'label', 2)}) GROUP BY length""",
)


def pair_parts(rows: str, size: int) -> dict[str, str]:
    """Every pair of vectors that shares a prefix, which small tables allow."""
    return {
        "rows": prefixes_of(rows, size),
        "cosines": """SELECT a.length, a.prefix, list_cosine_similarity(a.e, b.e) AS c
            FROM rows a JOIN rows b ON a.length = b.length AND a.prefix = b.prefix AND a.vec_id < b.vec_id""",
        "sizes": "SELECT length, prefix, count(*) AS n FROM rows GROUP BY length, prefix",
    }


ORACLES["prefix_cosine"] = with_parts(
    pair_parts(f"SELECT c.*, embedding::DOUBLE[] AS e FROM ({CODES}) c JOIN embeddings USING (vec_id)", 3),
    """SELECT length, prefix, n, round(avg(c), 6) AS cosine FROM sizes LEFT JOIN cosines USING (length, prefix)
       GROUP BY length, prefix, n""",
)
ORACLES["prefix_cosine_by_length"] = with_parts(
    {**VECTOR_PARTS, "learned": LEARNED, **pair_parts("FROM learned", 2)},
    """SELECT length, num_prefixes, num_items, coalesce(num_pairs, 0) AS num_pairs, cosine
       FROM (SELECT length, count(*) AS num_prefixes, sum(n)::BIGINT AS num_items FROM sizes GROUP BY length)
       LEFT JOIN (SELECT length, count(*) AS num_pairs, round(avg(c), 6) AS cosine FROM cosines GROUP BY length) USING (length)""",
)


def hashed_sql(key: str, size: int, codes: int = 16) -> str:
    return "[" + ", ".join(f"floor({unit(42, key, str(p))} * {codes})::INTEGER" for p in range(size)) + "]"


def permuted_parts(rows: str, number: str, a: int, b: int) -> dict[str, str]:
    """Six rounds in which each digit of radix a and b is shifted by a draw from the other."""
    parts = {"digits0": f"SELECT *, ({number}) // {b} AS hi, ({number}) % {b} AS lo FROM ({rows})"}
    for r in range(6):
        shown = (
            f"(hi + floor({unit(42, str(r), 'lo')} * {a})::BIGINT) % {a} AS hi"
            if r % 2 == 0
            else f"(lo + floor({unit(42, str(r), 'hi')} * {b})::BIGINT) % {b} AS lo"
        )
        parts[f"digits{r + 1}"] = f"SELECT * REPLACE ({shown}) FROM digits{r}"
    return parts


ORACLES["baseline_hash_ids"] = f"SELECT p_partkey, array_to_string({hashed_sql('p_partkey', 3)}, ',') AS ids FROM part"
ORACLES["baseline_random_ids"] = with_parts(
    {**ALL_IDS, **permuted_parts("SELECT category, item_id FROM iid", "item_id - 1", 61, 61)},
    "SELECT category, item_id, CASE WHEN item_id <= 3721 THEN hi || ',' || lo END AS ids FROM digits6",
)
ORACLES["baseline_quality"] = with_parts(
    {
        **VECTOR_PARTS,
        **permuted_parts("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS number FROM embeddings", "number", 16, 256),
        "learned": LEARNED,
        "together": f"""SELECT 'learned' AS category, ids FROM learned
            UNION ALL SELECT 'hash', {hashed_sql('vec_id', 3)} FROM embeddings
            UNION ALL SELECT 'random', [hi, lo // 16, lo % 16] FROM digits6""",
    },
    quality("FROM together"),
)
COLLISIONS = {
    "coded": f"SELECT p_partkey AS item, {hashed_sql('p_partkey', 2)} AS ids FROM part",
    "may": """SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS x, greatest(a.l_partkey, b.l_partkey) AS y
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        WHERE a.l_partkey <> b.l_partkey""",
    "colliding": """SELECT a.ids, x IS NOT NULL AS benign FROM coded a JOIN coded b ON a.ids = b.ids AND a.item < b.item
        LEFT JOIN may ON x = a.item AND y = b.item""",
    "tuples": """SELECT ids, n, count(*) AS pairs, count(*) FILTER (benign) AS benign, count(*) FILTER (NOT benign) AS harmful
        FROM colliding JOIN (SELECT ids, count(*) AS n FROM coded GROUP BY ids) USING (ids) GROUP BY ids, n""",
}
ORACLES["tuple_collisions"] = with_parts(COLLISIONS, "SELECT * REPLACE (array_to_string(ids, ',') AS ids) FROM tuples")
ORACLES["collision_split"] = with_parts(
    COLLISIONS,
    """SELECT *, round(harmful / pairs, 6) AS harmful_rate, round(harmful_items / num_items, 6) AS harmful_item_rate
       FROM (SELECT (SELECT count(*) FROM coded) AS num_items, sum(pairs)::BIGINT AS pairs, sum(benign)::BIGINT AS benign,
                    sum(harmful)::BIGINT AS harmful, sum(n) FILTER (harmful > 0)::BIGINT AS harmful_items FROM tuples)""",
)
SIDE_BY_SIDE = {
    **VECTOR_PARTS,
    **permuted_parts("SELECT vec_id, label, e, row_number() OVER (ORDER BY vec_id) - 1 AS number FROM v0", "number", 16, 16),
    "learned": LEARNED,
    "coded_all": f"""SELECT 'learned' AS category, vec_id, label, e, ids FROM learned
        UNION ALL SELECT 'hash', vec_id, label, e, {hashed_sql('vec_id', 2)} FROM v0
        UNION ALL SELECT 'random', vec_id, label, e, [hi, lo] FROM digits6 WHERE number < 256""",
    "by_prefix": "SELECT *, array_to_string(ids[1:length], ',') AS prefix FROM (SELECT *, unnest([1, 2]) AS length FROM coded_all)",
    "label_shares": """SELECT category, length, prefix, label, count(*) AS c,
        count(*) / sum(count(*)) OVER (PARTITION BY category, length, prefix) AS share FROM by_prefix GROUP BY category, length, prefix, label""",
    "purities": """SELECT category, length, prefix, sum(c) AS n, max(share) AS purity, -sum(share * ln(share)) AS entropy
        FROM label_shares GROUP BY category, length, prefix""",
    "pairs_of": """SELECT category, length, avg(list_cosine_similarity(a.e, b.e)) AS cosine
        FROM by_prefix a JOIN by_prefix b USING (category, length, prefix) WHERE a.vec_id < b.vec_id GROUP BY category, length""",
    "meet": """SELECT category, ids, count(*) AS pairs, count(*) FILTER (b.vec_id <> a.vec_id + 1) AS harmful
        FROM coded_all a JOIN coded_all b USING (category, ids) WHERE a.vec_id < b.vec_id GROUP BY category, ids""",
    "sizes_of": "SELECT category, ids, count(*) AS n FROM coded_all GROUP BY category, ids",
    "harms": """SELECT category, coalesce(sum(harmful) / sum(pairs), 0) AS rate, coalesce(sum(n) FILTER (harmful > 0), 0) / sum(n) AS item_rate
        FROM sizes_of LEFT JOIN meet USING (category, ids) GROUP BY category""",
}
ORACLES["code_comparison"] = with_parts(
    SIDE_BY_SIDE,
    f"""SELECT p.category AS source, p.length::INTEGER AS length, num_prefixes, purity, entropy, round(cosine, 6) AS cosine,
        codebook_perplexity, active_codes, collision_rate, uniqueness, round(rate, 6) AS harmful_rate, round(item_rate, 6) AS harmful_item_rate
        FROM (SELECT category, length, count(*) AS num_prefixes, round(sum(n * purity) / sum(n), 6) AS purity,
                     round(sum(n * entropy) / sum(n), 6) AS entropy FROM purities GROUP BY category, length) p
        LEFT JOIN pairs_of USING (category, length) JOIN ({quality('FROM coded_all')}) q USING (category) JOIN harms USING (category)""",
)

"""DuckDB statements of hard negatives, shards and the manifest."""

HARD_NEGATIVES = """
  WITH given AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
             FROM given a JOIN given b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
                QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
  SELECT anchor_id, positive_id,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
         vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scores USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
  QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""

#: The checksum's table follows from its polynomial, one entry for each byte.
_CRC = """
  crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"""


def _crc(codes: str) -> str:
    """CRC-32 of a list of byte values, unsigned; ``crc_table`` must stand beside what it reads."""
    return (
        f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {codes}),"
        " lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"
    )


#: Levels of nodes over a language and over the languages: 8 ** 8 leaves and 512 languages.
LEAF_LEVELS, TOP_LEVELS = 8, 3


def _levels(source: str, name: str, count: int) -> str:
    """Nodes and runs of a tree: ``name0`` is ``(tree, i, h, n)``, with ``n`` nodes in the level."""
    parts = [f"{name}0 AS (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n FROM {source})"]
    for k in range(count):
        parts.append(
            f"{name}_run{k} AS (SELECT tree, i // 8 AS i, list(h ORDER BY i) AS run FROM {name}{k} WHERE n > 1 GROUP BY tree, i // 8)"
        )
        parts.append(
            f"{name}{k + 1} AS (SELECT tree, i, sha256(array_to_string(run, '')) AS h, count(*) OVER (PARTITION BY tree) AS n FROM {name}_run{k})"
        )
    tops = " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(count + 1))
    return ",\n  ".join([*parts, f"{name}_top AS ({tops})"])


def _climb(source: str, name: str, count: int) -> str:
    """Siblings gathered and nodes folded, level by level: ``tree, i, proof, folded`` and what identifies the leaf."""
    parts, before = [], source
    for k in range(count):
        parts.append(f"""{name}_up{k} AS (
    SELECT s.* REPLACE (s.i // 8 AS i,
      s.proof || coalesce(array_to_string(list_concat(r.run[1:s.i % 8], r.run[s.i % 8 + 2:]), ''), '') AS proof,
      CASE WHEN r.run IS NULL THEN s.folded ELSE
        sha256(coalesce(array_to_string(r.run[1:s.i % 8], ''), '') || s.folded || coalesce(array_to_string(r.run[s.i % 8 + 2:], ''), '')) END AS folded)
    FROM {before} s LEFT JOIN {name}_run{k} r ON r.tree = s.tree AND r.i = s.i // 8)""")
        before = f"{name}_up{k}"
    return ",\n  ".join(parts)


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR, '-')"


_FIELDS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

MANIFEST = (
    f"WITH {_CRC},\n"
    + f"""  hashed AS (
    SELECT coalesce('1' || lang, '0') AS tree, doc_id, sha256({_FIELDS} || {_field("text")}) AS h,
           sha256({_FIELDS} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS lowered,
           {_crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 3 = 0 AND text IS NOT NULL AS altered
    FROM documents, crc_table),
  leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM hashed),
  """
    + _levels("leaves", "low", LEAF_LEVELS)
    + """,
  subroots AS (SELECT '' AS tree, tree AS lang, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM low_top),
  """
    + _levels("subroots", "top", TOP_LEVELS)
    + """,
  leaf_start AS (SELECT tree, i, doc_id, h AS leaf, '' AS proof, CASE WHEN altered THEN lowered ELSE h END AS folded FROM leaves),
  """
    + _climb("leaf_start", "leaf", LEAF_LEVELS).replace("leaf_run", "low_run")
    + f""",
  top_start AS (
    SELECT s.tree, s.i, l.doc_id, l.leaf, l.proof, l.folded, s.h AS subroot
    FROM leaf_up{LEAF_LEVELS - 1} l JOIN subroots s ON s.lang = l.tree),
  """
    + _climb("top_start", "over", TOP_LEVELS).replace("over_run", "top_run")
    + f"""
  SELECT doc_id, leaf, subroot, top_top.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = top_top.h AS verified
  FROM over_up{TOP_LEVELS - 1} JOIN top_top USING (tree)"""
)

#: The draws of the shards: the mixer of ``common.mix`` in whole numbers modulo 2 ** 64.
_MIX = [
    "xor({x}, {x} >> 30)",
    "(({x})::UHUGEINT * 13787848793156543929 % 18446744073709551616)::UBIGINT",
    "xor({x}, {x} >> 27)",
    "(({x})::UHUGEINT * 10723151780598845931 % 18446744073709551616)::UBIGINT",
    "xor({x}, {x} >> 31)",
]


def _mixed(source: str, name: str, column: str) -> str:
    """Tables that take ``column`` through the mixer, one step each."""
    parts, before = [], source
    for k, step in enumerate(_MIX):
        parts.append(f"{name}{k} AS (SELECT * REPLACE ({step.format(x=column)} AS {column}) FROM {before})")
        before = f"{name}{k}"
    return ",\n  ".join(parts)


SHARDS = (
    f"WITH {_CRC},\n  "
    + r"""bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
  sized AS (
    SELECT doc_id, octet_length(encode(body))::BIGINT + 16 AS size, """
    + _crc(
        r"list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT)"
    )
    + r""" AS text_crc32,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT AS k
    FROM bodies, crc_table),
  names AS (SELECT shard::INTEGER AS shard, (shard + 1)::UBIGINT AS salt FROM range(41) AS r(shard)),
  """
    + _mixed("names", "salted", "salt")
    + """,
  pairs AS (SELECT doc_id, size, text_crc32, shard, xor(k, salt) AS draw FROM sized, salted4),
  """
    + _mixed("pairs", "drawn", "draw")
    + """,
  placed AS (
    SELECT doc_id, size, text_crc32, arg_max(shard, draw >> 11) FILTER (WHERE shard < 40) AS shard, arg_max(shard, draw >> 11) AS grown_shard, copies
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, size, text_crc32, shard) AS copies FROM drawn4)
    GROUP BY doc_id, size, text_crc32, copies)
  SELECT doc_id, size, text_crc32, 'key' AS law, shard,
         row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
  FROM (SELECT *, unnest(range(copies)) FROM placed)"""
)

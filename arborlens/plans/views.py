"""Input views of the registered queries, in SQL that Spark and DuckDB both accept.

They give the given tables the shape the operators work on: ``documents`` become source files,
``events`` become responses of models, ``part`` becomes a model catalogue. Every row and every
whole text is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE_FILES = """
SELECT doc_id AS file_id,
       concat('p', CAST(doc_id % 7 AS STRING)) AS project,
       CASE
         WHEN doc_id < 7 THEN 'README.md'
         WHEN doc_id < 14 THEN 'ARCHITECTURE.md'
         WHEN doc_id % 100 = 14 THEN concat('pages/[mn]', CAST(doc_id AS STRING), '.ts')
         WHEN doc_id % 100 = 84 THEN concat('pages/m', CAST(doc_id - 70 AS STRING), '.ts')
         WHEN doc_id % 100 = 24 THEN concat('.dist/m', CAST(doc_id AS STRING), '.c')
         WHEN doc_id % 100 = 34 THEN concat('cmd/', lang, '/m', CAST(doc_id AS STRING), '.go')
         WHEN doc_id % 100 = 44 THEN concat('src/_priv/.m', CAST(doc_id AS STRING), '.css')
         WHEN doc_id % 10 = 0 THEN concat('src/m', CAST(doc_id AS STRING), '.py')
         WHEN doc_id % 10 = 1 THEN concat('src/m', CAST(doc_id AS STRING), '.ts')
         WHEN doc_id % 10 = 2 THEN concat('lib/', lang, '/m', CAST(doc_id AS STRING), '.JS')
         WHEN doc_id % 10 = 3 THEN concat('lib/m', CAST(doc_id AS STRING), '.go')
         WHEN doc_id % 10 = 4 THEN concat('Makefile_', CAST(doc_id AS STRING))
         WHEN doc_id % 10 = 5 THEN concat('src/node_modules/q', CAST(doc_id AS STRING), '/index.js')
         WHEN doc_id % 10 = 6 THEN concat('src/m', CAST(doc_id AS STRING), '.test.ts')
         WHEN doc_id % 10 = 7 THEN concat('assets/m', CAST(doc_id AS STRING), '.PNG')
         WHEN doc_id % 10 = 8 THEN concat('app/', lang, '/d', CAST(doc_id AS STRING), '/main.py')
         ELSE concat('docs/', lang, '/g', CAST(doc_id AS STRING), '.md')
       END AS path,
       concat('# head ', CAST(doc_id AS STRING), chr(10),
              'import src.m', CAST(doc_id - 70 AS STRING), chr(10),
              CASE WHEN doc_id = 30 THEN concat('import src.m100', chr(10)) ELSE '' END,
              'from src.m', CAST(doc_id - 140 AS STRING), ' import x', chr(10),
              'import y from ''./m', CAST(doc_id - 70 AS STRING), ''';', chr(10),
              '/* blk', chr(10), ' two */ a = 1; // tail', chr(10),
              'b = 2;  ', chr(10), chr(10), chr(10), chr(10), chr(10),
              '\"\"\"doc\"\"\"', chr(10), text, chr(10)) AS content
FROM documents
"""

RESPONSES = """
SELECT CAST(floor(event_id / 5.0) AS BIGINT) AS run_id,
       CASE event_id % 5 WHEN 0 THEN 'anthropic/a' WHEN 1 THEN 'openai/b'
                         WHEN 2 THEN 'google/c' WHEN 3 THEN 'mistral/d' ELSE 'local' END AS model,
       CASE WHEN user_id % 10 = 0 THEN 'failed' WHEN user_id % 10 = 1 THEN 'timeout' ELSE 'complete' END AS status,
       CAST(floor(value * 10) AS BIGINT) AS latency_ms,
       CAST(event_id % 1000 AS BIGINT) AS tokens_prompt,
       CAST(user_id % 500 AS BIGINT) AS tokens_completion,
       concat('gen-', CAST(event_id AS STRING)) AS generation_id,
       CASE WHEN user_id % 10 IN (0, 1) THEN ''
            WHEN event_id % 13 = 0 THEN 'plain prose, not json'
            WHEN event_id % 17 = 0 THEN '{"key_concerns":["no consultation"]}'
            WHEN event_id % 19 = 0 THEN '{"consultation":5}'
            WHEN event_id % 23 = 0 THEN '{"consultation":"c","key_concerns":["k",null]}'
            WHEN event_id % 29 = 0 THEN '{"consultation":"c","files_referenced":null}'
            WHEN event_id % 31 = 0 THEN '{"consultation":"c","key_strengths":[],"key_concerns":["k0"]}'
            ELSE concat('{"consultation":"c', CAST(event_id AS STRING),
                        '","files_referenced":["m', CAST(user_id % 3 AS STRING),
                        '.py"],"key_concerns":["k', CAST(user_id % 4 AS STRING),
                        '","k', CAST(4 + event_id % 3 AS STRING), '"]}') END AS raw_response
FROM events
"""

GENERATION_STATS = """
SELECT concat(CASE WHEN event_type = 'error' THEN 'lost-' ELSE 'gen-' END, CAST(event_id AS STRING)) AS generation_id,
       value / 1000 AS cost
FROM events
"""

MODEL_CATALOG = """
SELECT concat(lower(replace(p_brand, '#', '-')), '/m', CAST(p_partkey AS STRING)) AS id,
       p_name AS name,
       CAST(CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size * 1000 END AS BIGINT) AS context_length,
       CAST(p_partkey % 40 AS DOUBLE) / 1000000 AS prompt_price,
       CAST(p_partkey % 90 AS DOUBLE) / 1000000 AS completion_price
FROM part
"""

CATALOG_DOCUMENTS = """
SELECT concat('{"data":[{"id":"', lower(replace(p_brand, '#', '-')), '/m', CAST(p_partkey AS STRING),
              '","name":"', p_name, '","context_length":', CAST(p_size * 1000 AS STRING),
              ',"pricing":{"prompt":"', CAST(p_partkey % 40 AS STRING), 'e-6","completion":"0.',
              CAST(p_partkey % 90 AS STRING), '"}},{"id":"free/m', CAST(p_partkey AS STRING), '"}]}') AS json
FROM part
"""

# Pages are HTML files of one more project; they hold comments.
PAGES = """
SELECT page_id AS file_id, 'web' AS project, concat('page', CAST(page_id AS STRING), '.html') AS path,
       html AS content
FROM pages
"""

# Excludes that each project keeps for itself.
PROJECT_EXCLUDES = """
SELECT DISTINCT s.project, CASE n.n
         WHEN 0 THEN '**/*.test.*'
         WHEN 1 THEN CASE s.project WHEN 'p0' THEN 'src/**' WHEN 'p1' THEN 'lib/*/m?*1.JS' WHEN 'p2' THEN '**/en/**'
                       WHEN 'p3' THEN 'src/m*3?.py' WHEN 'p4' THEN 'd**s/**/g*.md' ELSE '**/main.py' END
         WHEN 2 THEN CASE s.project WHEN 'p1' THEN 'src/node_modules/**/index.js' WHEN 'p2' THEN 'Make*'
                       WHEN 'p3' THEN 'assets/m**.PNG' WHEN 'p5' THEN 'app/**' ELSE 'no/such/file.py' END
       END AS pattern
FROM files s, (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) n
WHERE s.project <> 'p6'
"""

# Every file is mentioned once, in one of five spellings, by a run on some project.
MENTIONS = r"""
SELECT CAST(file_id % 16 AS BIGINT) AS run_id,
       CASE WHEN file_id % 11 = 0 THEN 'p0' ELSE project END AS project,
       CASE file_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS model,
       CASE floor(file_id / 10.0) % 5
         WHEN 0 THEN path
         WHEN 1 THEN concat('./', path, ':12')
         WHEN 2 THEN regexp_extract(path, '([^/]*)$', 1)
         WHEN 3 THEN regexp_extract(path, '(([^/]*/)?[^/]*)$', 1)
         ELSE concat(path, '#L4')
       END AS mention
FROM files
"""

# A curated tree over the scanned files: top folders, second-level folders, files, and a group of globs.
SEQUENCE_NODES = """
WITH placed AS (
  SELECT file_id, project, path,
         CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE 'root' END AS top,
         CASE WHEN path LIKE '%/%/%' THEN split_part(path, '/', 2) ELSE '' END AS sub
  FROM kept
)
SELECT project, concat('g:', top) AS node_id, CAST(NULL AS STRING) AS parent_id, min(file_id) AS pos,
       CAST(NULL AS STRING) AS path, top AS name,
       CASE WHEN top IN ('docs', 'pages') THEN 'alphabetical' ELSE 'manual' END AS ord
FROM placed GROUP BY project, top
UNION ALL
SELECT project, concat('g:', top, '/', sub), concat('g:', top), min(file_id), CAST(NULL AS STRING), sub,
       CASE WHEN sub = 'en' THEN 'alphabetical' ELSE 'dependency' END
FROM placed WHERE sub <> '' GROUP BY project, top, sub
UNION ALL
SELECT project, concat('f:', path), CASE WHEN sub = '' THEN concat('g:', top) ELSE concat('g:', top, '/', sub) END,
       file_id, path, CAST(NULL AS STRING), 'dependency'
FROM placed
UNION ALL
SELECT DISTINCT project, 'x:', CAST(NULL AS STRING), CAST(-1 AS BIGINT), CAST(NULL AS STRING), 'globs', 'manual'
FROM placed
UNION ALL
SELECT DISTINCT project, 'x:docs', 'x:', CAST(0 AS BIGINT), 'docs/**/*.md', CAST(NULL AS STRING), 'dependency'
FROM placed
UNION ALL
SELECT DISTINCT project, 'x:app', 'x:', CAST(1 AS BIGINT), 'app/[ef]*/d?[0-8]*/main.py', CAST(NULL AS STRING),
       'dependency'
FROM placed
UNION ALL
SELECT DISTINCT project, 'x:none', 'x:', CAST(2 AS BIGINT), 'no/such/file.py', CAST(NULL AS STRING), 'dependency'
FROM placed
"""

TABLES = ("documents", "events", "part", "pages", "conversations")


class Inputs:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def sql(self, text: str, **views: DataFrame) -> DataFrame:
        names = [t for t in TABLES if f"FROM {t}" in text]
        frames = {t: self.spark.read.parquet(f"{self.folder}/{t}.parquet") for t in names} | views
        text = text.replace("{", "{{").replace("}", "}}")
        for name in frames:
            text = text.replace(f"FROM {name}", "FROM {" + name + "}")
        return self.spark.sql(text, **frames)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def files(self) -> DataFrame:
        return self.sql(SOURCE_FILES)

    @property
    def responses(self) -> DataFrame:
        return self.sql(RESPONSES)

    @property
    def catalog(self) -> DataFrame:
        return self.sql(MODEL_CATALOG)

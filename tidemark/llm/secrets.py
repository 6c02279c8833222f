"""Secret scans over an incremental ledger of content-addressed blobs; Spark expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import if_small
from tidemark.session import materialize, row_count_at_most, scratch_path

#: The base rules, as (kind, pattern, least length, group measured).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: kind -> Java pattern. A run of 20 (24) or more characters is found by its bound just as
#: by finding all runs and dropping short ones, since the runs are maximal either way.
BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
EXTRA = {
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    # a run of its characters that two more don't follow is matched too, and dropped: so it's read once, not from every eyJ in it
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)?+",
    "forge": r"gh[opsur]_[A-Za-z0-9]{36,}",
}
KINDS = [*BASE, *EXTRA]
#: What follows a pem header without its END line: header fields, then runs of base64 of which only the last is short.
_BREAK, _FIELD = r"""(?:[\s"'>#,]|\\[rn])*+""", r"(?:Proc-Type|DEK-Info): [^\r\n\\]*+"
PEM_BODY = rf"^(?:{_BREAK}{_FIELD})*+(?:{_BREAK}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}+(?:={{1,2}}|(?=[\x20\t]*+(?:[\r\n]|\z))))?"
#: Names the set of rules: a change of any rule takes a new version, and only then are blobs scanned anew.
RULES_VERSION = "rules-1"

#: So many addresses may be broadcast (about 100 bytes each).
BROADCAST_BLOBS = 50_000

#: Matches of a text are gone through so many at a time.
SLICE = 256
SPAN = "array<struct<start:int,ord:int,stop:int,kind:string>>"


def spans_of(kind: str, pattern: str) -> str:
    """SQL for the spans of one rule in ``text``, as code points, the end exclusive.

    The text between matches and the matches alternate, so their lengths add up to the
    positions. A match of ``assign`` whose value has under 6 characters, or of ``jwt`` that is
    one run only, is dropped after it has consumed its text. Matches are gone through in slices, whose lists are put together at the
    end: an array that grows by one match at a time would be copied as often as there are matches.
    """
    rule = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    short = {"assign": f"length(regexp_extract(x.h, {rule}, 2)) < 6", "jwt": "instr(x.h, '.') = 0"}.get(kind, "false")
    walk = f"""
      aggregate(part, named_struct('at', acc.at, 'found', cast(array() as {SPAN})),
        (own, x) -> named_struct(
          'at', own.at + length(x.g) + coalesce(length(x.h), 0),
          'found', if(x.h is null or {short}, own.found,
            concat(own.found, array(named_struct('start', own.at + length(x.g), 'ord', {KINDS.index(kind)},
              'stop', own.at + length(x.g) + length(x.h), 'kind', '{kind}'))))))"""
    return f"""
      if(not text rlike {rule}, cast(array() as {SPAN}),
        flatten(aggregate(
          transform(array(zip_with(regexp_extract_all(text, {rule}, 0), split(text, {rule}, -1), (h, g) -> named_struct('h', h, 'g', g))),
            all -> transform(sequence(0, (size(all) - 1) div {SLICE}), i -> slice(all, i * {SLICE} + 1, {SLICE})))[0],
          named_struct('at', 0, 'found', cast(array() as array<{SPAN}>)),
          (acc, part) -> transform(array({walk}), t -> named_struct('at', t.at, 'found', concat(acc.found, array(t.found))))[0],
          acc -> acc.found)))"""


def scan_blobs(blobs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """``blobs`` (blob, text) -> (blob, found): all spans, by start and then kind as listed."""
    rules = rules or BASE | EXTRA
    each = [F.expr(spans_of(kind, pattern)) for kind, pattern in rules.items()]
    return blobs.select("blob", F.array_sort(F.flatten(F.array(*each))).alias("found"))


class BlobLedger:
    """What has been scanned, in a folder: one row (blob, rule_version, found) for each pair.

    ``record`` scans only the pairs of blob and rule version that the folder lacks, and adds
    them; ``findings`` joins the ledger back to all paths that hold a blob. A run that is
    stopped before its write commits leaves the ledger as it was.
    """

    def __init__(self, spark, path: str | None = None, version: str = RULES_VERSION, rules: dict[str, str] | None = None):
        self.spark, self.path, self.version, self.rules = spark, path or scratch_path(spark, "ledger"), version, rules
        self.schema = f"blob string, rule_version string, found {SPAN}"
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path(self.path)

    def rows(self) -> DataFrame:
        there = self._fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self._fs_path)
        return self.spark.read.schema(self.schema).parquet(self.path) if there else self.spark.createDataFrame([], self.schema)

    def unseen(self, versions: DataFrame) -> DataFrame:
        """The blobs of ``versions`` (blob, text) not yet scanned with these rules, each once.

        What is unseen is found from the addresses alone. Their texts stay where they are if
        few blobs are unseen, or if few are seen or repeated; otherwise they are shuffled.
        """
        known = versions.select("blob", "text")
        seen = self.rows().where(F.col("rule_version") == self.version).select("blob").distinct()
        addresses = known.groupBy("blob").agg(F.count("*").alias("n"))
        fresh = materialize(addresses.join(seen, "blob", "left_anti"), "unseen-blobs")
        if row_count_at_most(fresh, BROADCAST_BLOBS):
            return known.join(F.broadcast(fresh.select("blob")), "blob", "left_semi").groupBy("blob").agg(F.any_value("text").alias("text"))
        repeated = fresh.where("n > 1").select("blob")
        apart = materialize(seen.unionByName(repeated), "set-apart")
        if row_count_at_most(apart, BROADCAST_BLOBS):
            again = known.join(F.broadcast(repeated), "blob", "left_semi").groupBy("blob").agg(F.any_value("text").alias("text"))
            return known.join(F.broadcast(apart), "blob", "left_anti").unionByName(again)
        return known.join(fresh.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.any_value("text").alias("text"))

    def record(self, versions: DataFrame) -> None:
        """Scan what is unseen of ``versions`` and add it to the ledger."""
        found = scan_blobs(self.unseen(versions), self.rules)
        found.select("blob", F.lit(self.version).alias("rule_version"), "found").write.mode("append").parquet(self.path)

    def findings(self, paths: DataFrame) -> DataFrame:
        """``paths`` (blob and any other columns) with ``found``, the spans of their blob."""
        return paths.join(self.scanned(), "blob", "left")

    def scanned(self) -> DataFrame:
        """(blob, found) of these rules; two runs that record a blob at the same time leave one row here."""
        rows = self.rows().where(F.col("rule_version") == self.version)
        return rows.groupBy("blob").agg(F.any_value("found").alias("found"))


def content_address(docs: DataFrame) -> DataFrame:
    """Adds ``blob``, the SHA-256 of the text, in place of any column of that name; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("text", text).withColumn("blob", F.sha2(F.encode(text, "UTF-8"), 256))


def scan_secrets(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """Secrets in the whole text of every row: doc_id, blob, found, counts and digests.

    Equal texts are scanned once and share their spans; a null or empty text has none, and a
    long one is scanned whole. Repeated rows each get a row. Spans that begin together are
    ordered by kind. Other columns are ignored, whatever their names; an empty table gives
    an empty result.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    addressed = content_address(docs.select("doc_id", "text"))
    ledger.record(addressed)
    found = ledger.findings(addressed.select("doc_id", "blob"))
    return found.select("doc_id", "blob", "found")


def scan_history(versions: list[DataFrame], ledger: BlobLedger | None = None) -> DataFrame:
    """The secrets of the last of ``versions`` (doc_id, text), after each of them went through one ledger in turn.

    A version scans only the blobs that no version before it had; what they held is joined
    back to the paths of the last. Rows as in :func:`scan_secrets`.
    """
    ledger = ledger or BlobLedger(versions[-1].sparkSession)
    for docs in versions[:-1]:
        ledger.record(content_address(docs.select("doc_id", "text")))
    return scan_secrets(versions[-1], ledger)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text, from the rows of :func:`scan_secrets`."""
    told = "transform({}, x -> concat_ws(':', x.kind, x.start, x.stop))"
    base = f"filter(found, x -> x.ord < {len(BASE)})"
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *counts,
        F.sha2(F.expr(f"concat_ws(',', {told.format(base)})"), 256).alias("base_sha256"),
        F.expr(f"concat_ws(',', {told.format('found')})").alias("spans"),
    )


def whole_keys(text: str, found: str) -> str:
    """SQL for ``found`` with each pem span drawn out from its header over the key in ``text``.

    That is through the END line of the same label, if no other key begins before it, or
    else to the end of the base64 body, which has a run of at least 16 characters.
    """
    body = "'" + PEM_BODY.replace("\\", "\\\\").replace("'", "\\'") + "'"
    header = f"regexp_extract(substring({text}, x.start + 1, x.stop - x.start), 'BEGIN ([A-Z ]*)PRIVATE KEY', 1)"
    rest, end = f"substring({text}, x.stop + 1)", f"concat('-----END ', {header}, 'PRIVATE KEY-----')"
    at, following = f"instr({rest}, {end})", f"instr({rest}, '-----BEGIN ')"
    more = f"if({at} > 0 and ({following} = 0 or {at} < {following}), {at} - 1 + length({end}), length(regexp_extract({rest}, {body}, 0)))"
    return f"transform({found}, x -> if(x.kind = 'pem', named_struct('start', x.start, 'ord', x.ord, 'stop', x.stop + {more}, 'kind', x.kind), x))"


def redact(docs: DataFrame, mark: str = "[secret]", ledger: BlobLedger | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and n_chars counted anew; all rows stay.

    A private key goes whole, though its span is only its header.

    Every blob is scanned once, whatever rows hold it; only texts with findings are rewritten,
    every other row passes as it is. Overlapping spans are one. Null and empty texts stay as
    they are, long ones are read whole, repeated rows are rewritten alike. All columns are
    kept under their names, as the operator's own are made in a struct of a name that no
    column has; an empty table gives an empty result.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    names = docs.columns
    addressed = content_address(docs.select("text"))
    ledger.record(addressed)
    own = _fresh("secrets", names)
    hits = ledger.scanned().where(F.size("found") > 0).select(F.col("blob").alias(f"{own}_blob"), F.col("found").alias(f"{own}_found"))
    hits = if_small(materialize(hits, "secret-hits"), BROADCAST_BLOBS)
    address = F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256)
    joined = docs.join(hits, address == F.col(f"{own}_blob"), "left")
    # a span opens a new cut unless one before it, by order of start, reaches it
    cuts = f"""
      aggregate({whole_keys("text", f"{own}_found")}, named_struct('done', cast(array() as array<struct<a:int,b:int>>), 'a', -1, 'b', -1), (acc, x) ->
        if(acc.b >= x.start and acc.a >= 0, named_struct('done', acc.done, 'a', acc.a, 'b', greatest(acc.b, x.stop)),
           named_struct('done', if(acc.a < 0, acc.done, array_append(acc.done, named_struct('a', acc.a, 'b', acc.b))), 'a', x.start, 'b', x.stop)),
        acc -> array_append(acc.done, named_struct('a', acc.a, 'b', acc.b)))"""
    m = f"{own}_cuts"
    pieces = f"transform({m}, (x, i) -> substring(text, if(i = 0, 0, {m}[i - 1].b) + 1, x.a - if(i = 0, 0, {m}[i - 1].b)))"
    clean = f"concat(array_join({pieces}, '{mark}'), '{mark}', substring(text, element_at({m}, -1).b + 1))"
    fresh = joined.withColumn(m, F.expr(f"if({own}_found is null, null, {cuts})")).withColumn(f"{own}_text", F.expr(f"if({m} is null, text, {clean})"))
    new = {"text": F.col(f"{own}_text"), "n_chars": F.expr(f"if({m} is null, n_chars, cast(length({own}_text) as long))") if "n_chars" in names else None}
    return fresh.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names])


def _fresh(word: str, names: list[str]) -> str:
    """A name that begins no column's."""
    while any(n.lower().startswith(word) for n in names):
        word += "_"
    return word


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k(kind, ord, pattern) AS (VALUES
  ('assign', 0, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+'),
  ('pem', 3, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'),
  ('jwt', 4, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'),
  ('forge', 5, 'gh[opsur]_[A-Za-z0-9]{36,}')),
p AS (
  SELECT doc_id, kind, ord, generate_subscripts(h, 1) AS i, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap
  FROM (SELECT doc_id, kind, ord, CASE ord
          WHEN 0 THEN regexp_extract_all(text, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
          WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+')
          WHEN 2 THEN regexp_extract_all(text, '[0-9a-f]+')
          WHEN 3 THEN regexp_extract_all(text, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----')
          WHEN 4 THEN regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}')
          ELSE regexp_extract_all(text, 'gh[opsur]_[A-Za-z0-9]{36,}') END AS h,
          string_split_regex(text, pattern) AS g
        FROM d, k)
  WHERE len(h) > 0),
q AS (
  SELECT doc_id, kind, ord, hit,
         CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop
  FROM p),
s AS (
  SELECT doc_id, kind, ord, stop - length(hit) AS start, stop FROM q
  WHERE CASE ord WHEN 0 THEN length(regexp_extract(hit, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6
                 WHEN 1 THEN length(hit) >= 20 WHEN 2 THEN length(hit) >= 24 ELSE true END),
a AS (
  SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3), '') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""

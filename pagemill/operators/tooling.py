"""Baselines, requirement audits, manifests, ordering forms and searches over several sources, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T


def new_rows(report: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a report whose key the baseline does not have."""
    return report.join(baseline.select(*keys).distinct(), keys, "left_anti")


def rewritten_baseline(report: DataFrame, keys: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """What a baseline file holds of a report: its keys in order and its metrics rounded."""
    return report.select(*keys, *(F.round(m, digits).alias(m) for m in metrics)).orderBy(*keys)


def with_minimum(needs: DataFrame, policy: DataFrame, explicit: str = "minimum", default: str = "policy_minimum") -> DataFrame:
    """needs with the number of files that each requirement asks for: its own, else that of its policy, else 1."""
    joined = needs.join(policy, "policy", "left")
    return joined.withColumn("needed_files", F.coalesce(explicit, default, F.lit(1)).cast("int")).drop(default)


#: Beginnings of tokens whose rest also counts as evidence, up to a dot or colon.
TOKEN_KINDS = "filter: stream-filter: image-filter: image-color: colorspace: decodeparms: ccitt: dct: jbig2: jpx: image: policy: graphics: placement: bpc:".split()
SHORTEST_TOKEN = 3


def evidence_tokens(requirements: DataFrame) -> DataFrame:
    """(requirement, token), once each: what shows that a requirement is tested, from requirements (requirement, needed, covers).

    Its own name, the features it needs, what it must cover from three characters on, and of each of these that begins with a kind what stands
    between that and the next dot or colon, from three characters on. Null lists are empty.
    """
    none = F.array().cast("array<string>")
    tokens = F.concat(F.array("requirement"), F.coalesce("needed", none), F.filter(F.coalesce("covers", none), lambda t: F.length(t) >= SHORTEST_TOKEN))
    given = requirements.select("requirement", F.explode(tokens).alias("token")).where("token is not null")
    rest = F.lit(None).cast("string")
    for kind in TOKEN_KINDS:
        rest = F.when(F.startswith("token", F.lit(kind)), F.regexp_extract(F.substring("token", F.lit(len(kind) + 1), F.length("token")), "^([^.:]*)", 1)).otherwise(rest)
    both = given.select("requirement", F.explode(F.array("token", F.when(F.length(rest) >= SHORTEST_TOKEN, rest))).alias("token"))
    return both.where("token is not null").distinct()


def token_evidence(tokens: DataFrame, files: DataFrame, first: int) -> DataFrame:
    """(requirement, file, nth): the first files, in order, that have any token of a requirement anywhere in their text, whatever the case.

    tokens (requirement, token) is a policy's word list, which the driver reads; each text is looked at once for all tokens. Of each requirement a task
    sends at most `first` files on. Tokens that are empty and texts that are null are no evidence.
    """
    by_token: dict[str, set[str]] = {}
    for r in tokens.where("token <> ''").select("requirement", F.lower("token").alias("token")).distinct().collect():
        by_token.setdefault(r.token, set()).add(r.requirement)
    policy = F.array(*(F.struct(F.lit(t).alias("token"), F.array(*map(F.lit, sorted(rs))).alias("requirements")) for t, rs in sorted(by_token.items()))) if by_token else F.array().cast("array<struct<token:string,requirements:array<string>>>")
    seen = files.where("text is not null").select("file", F.lower("text").alias("_t"))
    met = F.array_distinct(F.flatten(F.transform(F.filter(policy, lambda p: F.contains(F.col("_t"), p["token"])), lambda p: p["requirements"])))
    found = seen.select("file", F.explode(met).alias("requirement"))
    ordered = Window.partitionBy("requirement").orderBy("file")
    return found.withColumn("nth", F.row_number().over(ordered)).where(F.col("nth") <= first).select("requirement", "file", "nth")


def coverage_status(requirements: DataFrame, atomic: DataFrame, corpus: DataFrame, default_atomic: int = 1, default_corpus: int = 1) -> DataFrame:
    """(requirement, atomic_count, corpus_count, status): COVERED, MISSING_CORPUS, MISSING_ATOMIC or MISSING_BOTH against each requirement's minimums.

    requirements (requirement, min_atomic, min_corpus; null: the default), atomic and corpus (requirement, file).
    """
    count = lambda rows, name: rows.groupBy("requirement").agg(F.count(F.lit(1)).alias(name))
    both = requirements.join(count(atomic, "atomic_count"), "requirement", "left").join(count(corpus, "corpus_count"), "requirement", "left").fillna(0, ["atomic_count", "corpus_count"])
    unit, whole = F.col("atomic_count") >= F.coalesce("min_atomic", F.lit(default_atomic)), F.col("corpus_count") >= F.coalesce("min_corpus", F.lit(default_corpus))
    status = F.when(unit & whole, "COVERED").when(unit, "MISSING_CORPUS").when(whole, "MISSING_ATOMIC").otherwise("MISSING_BOTH")
    return both.select("requirement", "atomic_count", "corpus_count", status.alias("status"))


def requirement_state(failing: Column, files: Column, unit: Column, atomic: Column) -> Column:
    """The first that holds: a failing render, no file in the corpus, no unit test, not atomic; else covered."""
    return F.when(failing > 0, "FAILING_RENDER").when(files == 0, "MISSING_CORPUS").when(~unit, "MISSING_UNIT").when(~atomic, "NOT_ATOMIC").otherwise("COVERED")


def rows_with_token(rows: DataFrame, token: str) -> DataFrame:
    """Rows that have the token anywhere in their serialised form, whatever its case."""
    return rows.where(F.contains(F.lower(F.to_json(F.struct(*rows.columns))), F.lit(token.lower())))


def projected_manifest(entries: DataFrame, features: list[str]) -> DataFrame:
    """(path, page_no) of entries that are OK and have any of the features; page 0 stands for the whole file."""
    chosen = entries.where((F.col("status") == "OK") & F.arrays_overlap("features", F.array(*map(F.lit, features))))
    return chosen.select("path", F.coalesce("page_no", F.lit(0)).alias("page_no")).distinct()


def dangling_paths(documents: DataFrame, json: str, known: DataFrame, key: str = "file") -> DataFrame:
    """Paths that stand under a key at any depth of a JSON column and are not among the known (path)."""
    found = documents.select(F.explode(F.regexp_extract_all(json, F.lit(rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))).alias("path")).distinct()
    return found.join(known.select("path").distinct(), "path", "left_anti")


def top_phases(phases: DataFrame, n: int) -> DataFrame:
    """Phases by total and count, largest first, then by name; all of them for n = 0."""
    ordered = phases.groupBy("phase").agg(F.sum("ms").alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), F.desc("n"), "phase")
    return ordered.limit(n) if n else ordered


def owned_first(rows: DataFrame, owned: Column) -> DataFrame:
    """Rows of owned scopes first, then by total, largest first, then by name."""
    return rows.withColumn("owned", owned).orderBy(F.desc("owned"), F.desc("total"), "phase")


def split_mode(modes: dict[str, object]) -> str:
    """The one split mode that is given; none or several are an error."""
    given = [name for name, value in modes.items() if value]
    if len(given) != 1:
        raise ValueError(f"exactly one of {', '.join(modes)} must be given, not {len(given)}")
    return given[0]


def expectation_met(expected: Column, status: Column, contains: Column, message: Column, diagnostic: Column) -> Column:
    """The status is the expected one or anything is expected, and the expected error text, if any, is in message or diagnostic."""
    text = F.coalesce(contains, F.lit(""))
    said = (text == "") | F.coalesce(F.contains(message, text), F.lit(False)) | F.coalesce(F.contains(diagnostic, text), F.lit(False))
    return ((expected == "*") | (expected == status)) & said


def visible(letters: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Letters that are not in a layer which is switched off, unless those are asked for."""
    return letters if include_hidden else letters.where(~F.coalesce("hidden_layer", F.lit(False)))


def fields_of(fields: DataFrame, kind: str) -> DataFrame:
    return fields.where(F.col("kind") == kind)


def find_field(fields: DataFrame, full_name: str) -> DataFrame:
    """Of each document the first field with exactly that name."""
    return fields.where(F.col("full_name") == full_name).groupBy("doc_id").agg(F.min_by(F.struct("ordinal", "kind", "value"), "ordinal").alias("x")).select("doc_id", "x.*")


def transformed(ops: DataFrame, change: dict[str, Column]) -> DataFrame:
    """ops with each operator mapped; places and operators that the change leaves alone stay."""
    return ops.withColumns(change)


def inserted(ops: DataFrame, at: int, new: DataFrame) -> DataFrame:
    """ops of each page with the new ones (doc_id, page_no, nth, name, …) before place `at`; places behind move up."""
    added = new.groupBy("doc_id", "page_no").agg(F.count("*").alias("_added"))
    moved = ops.join(added, ["doc_id", "page_no"], "left").withColumn("op_idx", F.when(F.col("op_idx") >= at, F.col("op_idx") + F.coalesce("_added", F.lit(0))).otherwise(F.col("op_idx"))).drop("_added")
    return moved.unionByName(new.withColumn("op_idx", F.lit(at) + F.col("nth")).drop("nth"), allowMissingColumns=True)


def replaced(ops: DataFrame, at: int, name: Column, text: Column) -> DataFrame:
    """ops with another operator in one place of every page that has it."""
    here = F.col("op_idx") == at
    return ops.withColumn("name", F.when(here, name).otherwise(F.col("name"))).withColumn("text", F.when(here, text).otherwise(F.col("text")))


def search_sources(sources: dict[str, DataFrame], term: str, whole_word: bool = False) -> DataFrame:
    """(doc_id, page_no, text, source): entries of several sources (page text, annotations, form values) with the term, whatever the
    case, both in matching form; entries that are not page text carry their source as a tag."""
    out = None
    term = T.fold_text(term)
    for source, rows in sources.items():
        text = F.lower(T.fold(F.col("text")))
        escaped = "\\Q" + term.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E"
        hit = text.rlike(rf"\b{escaped}\b") if whole_word else F.contains(text, F.lit(term.lower()))
        tag = "" if source == "page" else f"[in {source}] "
        found = rows.where(hit).select("doc_id", "page_no", F.concat(F.lit(tag), F.col("text")).alias("text"), F.lit(source).alias("source"))
        out = found if out is None else out.unionByName(found)
    return out


def apply_actions(ops: DataFrame, actions: list[tuple[str, Column]]) -> DataFrame:
    """ops with action, the name of the first action whose condition holds, or null: an ordered list of redaction actions in one pass."""
    named = F.lit(None).cast("string")
    for name, condition in reversed(actions):
        named = F.when(condition, name).otherwise(named)
    return ops.withColumn("action", named)


def action_counts(acted: DataFrame, keys: list[str]) -> DataFrame:
    """Result counters of applied actions: operators and letters removed and kinds of operators hit."""
    gone = F.col("action").isNotNull()
    return acted.groupBy(*keys).agg(F.count_if(gone).alias("operators_removed"), F.coalesce(F.sum(F.when(gone, F.length("text"))), F.lit(0)).alias("letters_removed"), F.size(F.collect_set(F.when(gone, F.col("category")))).alias("categories"))


def without_obstructions(ops: DataFrame, least_area: float) -> DataFrame:
    """ops without the opaque fills of at least that area, which could cover text."""
    box = F.col("box")
    area = (box["r"] - box["l"]) * (box["t"] - box["b"])
    return ops.where(~F.coalesce(F.col("name").isin("f", "F", "f*", "re") & (area >= least_area), F.lit(False)))


def suggested_name(name: Column, action: str, n: Column | None = None) -> Column:
    """A file name with what was done to it before its ending, and a number where that name is taken; 999 is the last."""
    stem, ending = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    number = F.lit("") if n is None else F.when(n.between(1, 999), F.concat(F.lit("_"), n.cast("string"))).otherwise("")
    return F.concat(stem, F.lit(action), number, ending)


def pixel_metrics(pairs: DataFrame, keys: list[str], a: str, b: str, tolerance: int = 64) -> DataFrame:
    """Of paired samples: share over the tolerance, mean and largest absolute difference, root mean square, and structural similarity."""
    d = F.abs(F.col(a) - F.col(b))
    c1, c2 = 6.5025, 58.5225
    stats = pairs.groupBy(*keys).agg(F.avg((d > tolerance).cast("double")).alias("diff_fraction"), F.avg(d).alias("mae"), F.max(d).alias("max_difference"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.coalesce(F.var_samp(a), F.lit(0.0)).alias("_va"), F.coalesce(F.var_samp(b), F.lit(0.0)).alias("_vb"), F.coalesce(F.covar_samp(a, b), F.lit(0.0)).alias("_c"))
    ma, mb = F.col("_ma"), F.col("_mb")
    ssim = (2 * ma * mb + c1) * (2 * F.col("_c") + c2) / ((ma * ma + mb * mb + c1) * (F.col("_va") + F.col("_vb") + c2))
    return stats.withColumn("ssim", ssim).drop("_ma", "_mb", "_va", "_vb", "_c")


def parsed_date(text: Column) -> Column:
    """Timestamp of a date in the page format (D:YYYYMMDDHHmmSS and an offset), whose parts may be missing from the end; null otherwise."""
    part = lambda i, other: F.when(F.regexp_extract(text, _DATE, i) == "", other).otherwise(F.regexp_extract(text, _DATE, i))
    plain = F.concat(part(1, "0000"), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"))
    sign = F.when(F.regexp_extract(text, _DATE, 7) == "-", "-").otherwise("+")
    return F.when(text.rlike(_DATE), F.try_to_timestamp(F.concat(plain, sign, part(8, "00"), F.lit(":"), part(9, "00")), F.lit("yyyy-MM-dd HH:mm:ssxxx")))


#: The date pattern of the page format.
_DATE = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?([-+Z])?(?:(\d{2})'?(\d{2})?'?)?$"

"""Batch workflows as rows: steps with a status, the report over them, and their exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error categories and the exit code of each; 0 means that all steps passed.
EXIT_CODES = {"SCHEMA": 2, "SECURITY": 2, "VALIDATION": 2, "INPUT": 1, "RUNTIME": 1}


def steps_of(conversations: DataFrame, most_chars: int = 900) -> DataFrame:
    """Turns as ordered steps; one whose text is longer than most_chars fails."""
    rows = conversations.where("text is not null").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return rows.withColumn("status", F.when(F.col("n") > most_chars, "FAIL").otherwise("PASS"))


def report(steps: DataFrame, group: str, order: str) -> DataFrame:
    """(group, n_steps, n_run, n_passed, status): a run stops after its first failure and passes only if all steps ran and passed."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ran = F.coalesce(F.sum((F.col("status") == "FAIL").cast("int")).over(before), F.lit(0)) == 0
    counted = steps.withColumn("_ran", ran).groupBy(group).agg(F.count("*").alias("n_steps"), F.count_if("_ran").alias("n_run"), F.count_if(F.col("_ran") & (F.col("status") == "PASS")).alias("n_passed"))
    return counted.withColumn("status", F.when(F.col("n_passed") == F.col("n_steps"), "PASS").otherwise("FAIL"))


#: Commands by the short names that stand for them; those that write a changed copy need an output that is not their input.
ALIASES = {"info": "document.info", "text": "text.extract", "render": "page.render", "fill-form": "form.fill", "add-field": "form.add-field", "redact": "redaction.apply", "audit": "audit.hidden-text", "audit-hidden-text": "audit.hidden-text"}
CHANGING = ("form.fill", "form.add-field", "redaction.apply")
#: Codes of errors by their category; any other code is VALIDATION where the caller says so, else RUNTIME.
CODES = {"SCHEMA": ("MISSING_COMMAND", "UNKNOWN_COMMAND", "MISSING_INPUT", "MISSING_OUTPUT"), "SECURITY": ("UNSAFE_OVERWRITE_REFUSED",), "INPUT": ("FILE_NOT_FOUND", "PASSWORD_OR_ENCRYPTION_ERROR", "INVALID_INPUT")}


def command_name(command: Column) -> Column:
    """The command that a name or one of its short forms stands for; null for none."""
    name = F.nullif(F.trim(command), F.lit(""))
    found = name
    for short, full in ALIASES.items():
        found = F.when(name == short, full).otherwise(found)
    return found


def checked(steps: DataFrame, validation: set[str] = frozenset()) -> DataFrame:
    """steps (…, command, input, output, raised) with command as its full name, error_code and category (null for a step that passes).

    What a step asks for is judged before what it raised: no or an unknown command, no input, no output or its input as output where a copy is
    written. raised is the code of an error of the run itself; unknown ones become OPERATION_FAILED.
    """
    name, missing = command_name(F.col("command")), lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    writes = name.isin(*CHANGING)
    known = [c for codes in CODES.values() for c in codes] + sorted(validation)
    raised = F.when(F.col("raised").isin(*known), F.col("raised")).when(F.col("raised").isNotNull(), "OPERATION_FAILED")
    code = F.when(name.isNull(), "MISSING_COMMAND").when(~name.isin(*ALIASES.values()), "UNKNOWN_COMMAND").when(missing("input"), "MISSING_INPUT").when(writes & missing("output"), "MISSING_OUTPUT").when(writes & (F.trim("output") == F.trim("input")), "UNSAFE_OVERWRITE_REFUSED").otherwise(raised)
    judged = steps.withColumn("error_code", code).withColumn("command", name)
    category = F.when(F.col("error_code").isNull(), None)
    for kind, codes in CODES.items():
        category = category.when(F.col("error_code").isin(*codes), kind)
    return judged.withColumn("category", category.when(F.col("error_code").isin(*sorted(validation)), "VALIDATION").otherwise("RUNTIME"))


def run_results(judged: DataFrame, group: str, order: str) -> DataFrame:
    """(group, n_steps, n_run, error_code, category, exit_code): each run up to and with its first error."""
    first = F.min(F.when(F.col("error_code").isNotNull(), F.struct(order, "error_code", "category")))
    found = judged.groupBy(group).agg(F.count(F.lit(1)).alias("n_steps"), first.alias("_first"), F.array_sort(F.collect_list(order)).alias("_order"))
    n_run = F.when(F.col("_first").isNull(), F.col("n_steps")).otherwise(F.size(F.filter("_order", lambda x: x <= F.col(f"_first.{order}"))))
    return found.select(group, "n_steps", n_run.cast("long").alias("n_run"), "_first.error_code", "_first.category", exit_code(F.col("_first.category")).alias("exit_code"))


def exit_code(category: Column) -> Column:
    found = F.when(category.isNull(), 0)
    for name, code in EXIT_CODES.items():
        found = found.when(category == name, code)
    return found.otherwise(1)

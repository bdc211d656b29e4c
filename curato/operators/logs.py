"""Progress lines, losses by epoch, redaction and public metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How progress and losses stand in log lines.
EPOCH = r"(?i)epoch\s*[=:]?\s*(\d+)"
BAR_STEP = r"(?i)(?:step|steps)\s*:\s*\d+%\|[^|]*\|\s*(\d+)\s*/\s*(\d+)"
STEP = r"(?i)(?:step|steps)\s*[=:]?\s*(\d+)(?![\d%])(?:\s*/\s*(\d+))?"
LOSS = r"(?i)(?<![A-Za-z0-9_])(?:train_loss|avr_loss|loss)\s*[=:]\s*([0-9.eE+-]+)"
VALIDATION = r"(?i)(?:val_epoch_avg_loss|val_avg_loss|val_loss|validation_loss|loss/validation/(?:epoch|step)_average)\s*[=:]\s*([0-9.eE+-]+)"
SECRET = r"(?i)(api[_-]?key|token|authorization|password)\s*[:=]\s*([^\s,;]+)"
BEARER = r"(?i)bearer\s+[a-z0-9._~+/-]+"
WINDOWS_PATH = r"(?i)(?<![A-Za-z0-9])(?:[A-Z]:[\\/]|\\\\)[^\r\n\t\"']+"
POSIX_PATH = r"(?<![A-Za-z0-9:])/(?:home|Users|tmp|var/tmp|mnt)/[^\r\n\t\"']+"
DEVICE = r"GPU-[0-9a-fA-F-]{8,}"
# Keys left out of public metadata.
PRIVATE_KEYS = "base_model codex_runtime_root command_argv configured_root input_paths managed_runtime_root original_filename original_filenames original_path original_paths output_root projects_root training_command_arguments training_dataset_config".split()


def _group(line: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, index), F.lit(""))


def parse_progress(lines: DataFrame, line: str, default_total: int) -> DataFrame:
    """Adds epoch, step, total_steps, train_loss and validation_loss to the lines that have any of them."""
    text = F.col(line)
    epoch = _group(text, EPOCH, 1)
    bar, plain = _group(text, BAR_STEP, 1), _group(text, STEP, 1)
    total = F.when(bar.isNotNull(), _group(text, BAR_STEP, 2)).otherwise(_group(text, STEP, 2))
    loss, validation = _group(text, LOSS, 1), _group(text, VALIDATION, 1)
    rows = lines.where(epoch.isNotNull() | bar.isNotNull() | plain.isNotNull() | loss.isNotNull() | validation.isNotNull())
    return rows.select(
        *lines.columns,
        F.coalesce(epoch.cast("int"), F.lit(0)).alias("epoch"),
        F.coalesce(bar, plain, F.lit("0")).cast("int").alias("step"),
        F.greatest(F.lit(1), F.coalesce(total.cast("int"), F.lit(default_total))).alias("total_steps"),
        loss.try_cast("double").alias("train_loss"),
        validation.try_cast("double").alias("validation_loss"),
    )


def carry_epoch(parsed: DataFrame, run: str, order: str) -> DataFrame:
    """Replaces epoch 0 by the last one seen in the run's lines before, line by line: of lines with one number, too, each has its own place.

    That place is by what the lines say, as nothing else tells them apart: those with a smaller epoch, step and losses first. Lines without a number come last.
    """
    rest = [c for c in ("epoch", "step", "total_steps", "train_loss", "validation_loss") if c in parsed.columns]
    upto = Window.partitionBy(run).orderBy(F.asc_nulls_last(order), *rest).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parsed.withColumn("epoch", F.coalesce(F.last(F.when(F.col("epoch") > 0, F.col("epoch")), ignorenulls=True).over(upto), F.lit(0)))


def losses_by_epoch(parsed: DataFrame, run: str, order: str) -> DataFrame:
    """(run, epoch, train_loss, validation_loss): the last losses of each epoch; of lines with one number the largest; lines without a number have none."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & F.col(order).isNotNull(), F.struct(order, c))).alias(c)
    return parsed.where("epoch > 0").groupBy(run, "epoch").agg(last("train_loss"), last("validation_loss"))


def fill_losses(checkpoints: DataFrame, losses: DataFrame, keys: list[str]) -> DataFrame:
    """Checkpoints with the losses of their epoch where they have none."""
    both = checkpoints.alias("c").join(losses.alias("l"), keys, "left")
    return both.select(*keys, *(F.coalesce(f"c.{n}", f"l.{n}").alias(n) for n in ("train_loss", "validation_loss")))


def redact(text: Column, home: str | None = None) -> Column:
    """The text without values of keys, tokens and passwords, without bearer tokens, and with the home folder masked."""
    out = F.regexp_replace(F.regexp_replace(text, SECRET, "$1=[REDACTED]"), BEARER, "[REDACTED]")
    return F.replace(out, F.lit(home), F.lit("%USERPROFILE%")) if home else out


def mask_paths(text: Column) -> Column:
    """The text with local paths replaced; a text that is a path as a whole is replaced altogether."""
    whole = text.rlike(r"^[A-Za-z]:[\\/]") | text.startswith("\\\\") | (text.startswith("/") & ~text.startswith("//"))
    inside = F.regexp_replace(F.regexp_replace(text, WINDOWS_PATH, "<local-path>"), POSIX_PATH, "<local-path>")
    return F.when(whole, "<local-path>").otherwise(inside)


def device_aliases(rows: DataFrame, document: str, place: str, text: str) -> DataFrame:
    """(document, device, alias): devices named by the order in which a document first mentions them."""
    found = rows.select(document, place, F.posexplode(F.regexp_extract_all(text, F.lit(f"({DEVICE})"), F.lit(1))).alias("i", "device"))
    first = found.groupBy(document, "device").agg(F.min(F.struct(place, "i")).alias("f"))
    return first.select(document, "device", F.concat(F.lit("gpu-"), F.row_number().over(Window.partitionBy(document).orderBy("f")).cast("string")).alias("alias"))


def public_entries(entries: Column) -> Column:
    """A map without private keys, whatever their case."""
    return F.map_filter(entries, lambda k, v: ~F.lower(k).isin(*PRIVATE_KEYS))


def public_model_id(digest: Column) -> Column:
    """The digest as a public id, or that it isn't verified."""
    return F.when(digest.rlike("^[0-9a-fA-F]{64}$"), F.concat(F.lit("sha256:"), F.lower(digest))).otherwise("sha256:<unverified>")

"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

import os
import shutil
import tempfile
from functools import wraps

from curato.llm import chatformat, conversationtrie, decontaminate, filteraudit, mixing, neardup, passages, pii, pitmanyor, quality, syncmers, tokenfile, toxicity


def ship(spark) -> None:
    """Sends the library to executors that don't have it on their path, once for each session's context."""
    context = spark.sparkContext
    if getattr(context, "_curato_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="curato-lib-")
    archive = shutil.make_archive(os.path.join(folder, "curato"), "zip", root, "curato")
    context.addPyFile(archive)
    context._curato_shipped = True


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    """Each corpus query by name."""
    found = {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_neardup": neardup.op2_neardup,
        "op3_passages": passages.op3_passages,
        "op4_mixing": mixing.op4_mixing,
        "op10_syncmers": syncmers.op10_syncmers,
        "op5_quality": quality.op5_quality,
        "op6_toxicity": toxicity.op6_toxicity,
        "op8_lm": pitmanyor.op8_lm,
        "op9_pii": pii.op9_pii,
        "op7_token_output": tokenfile.op7_token_output,
        "op11_conversation_trie": conversationtrie.op11_conversation_trie,
        "op12_chat_format": chatformat.op12_chat_format,
        "op13_filter_audit": filteraudit.op13_filter_audit,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict:
    """The SQL of the corpus queries that SQL can express."""
    return {
        "op1_decontamination": decontaminate.OP1_SQL,
        "op4_mixing": mixing.OP4_SQL,
        "op11_conversation_trie": conversationtrie.OP11_SQL,
        "op12_chat_format": chatformat.OP12_SQL,
        "op13_filter_audit": filteraudit.OP13_SQL,
    }

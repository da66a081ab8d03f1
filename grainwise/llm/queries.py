"""The queries of this package over the given tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from grainwise.llm import chat, entropy, kdtree, lblm, licenses, lines, negatives, pii, simhash, syncmers, toxicity, trie, winnow
from grainwise.llm.common import table


def _over(operator, *more: str, main: str = "documents"):
    return lambda spark, folder: operator(*[table(spark, folder, name) for name in (main, *more)])


QUERIES = {
    "op1_syncmers": _over(syncmers.op1_syncmers),
    "op2_kdtree": _over(kdtree.op2_kdtree),
    "op3_toxicity": _over(toxicity.op3_toxicity, "labels"),
    "op4_crf": _over(pii.op4_crf),
    "op5_licenses": _over(licenses.op5_licenses),
    "op6_simhash": _over(simhash.op6_simhash),
    "op7_nce": _over(lblm.op7_nce),
    "op8_lines": _over(lines.op8_lines),
    "op9_winnow": _over(winnow.op9_winnow, "benchmark"),
    "op10_entropy": _over(entropy.op10_entropy),
    "op11_chat": _over(chat.op11_chat, main="conversations"),
    "op12_trie": _over(trie.op12_trie, main="conversations"),
    "op13_negatives": _over(negatives.op13_negatives, main="embeddings"),
}
#: Over documents; and over every table.
SQL = {"op8_lines": lines.OP8_SQL, "op9_winnow": winnow.OP9_SQL}
ORACLES = SQL | {"op11_chat": chat.OP11_SQL, "op12_trie": trie.OP12_SQL, "op13_negatives": negatives.OP13_SQL}

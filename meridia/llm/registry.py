"""The queries of this subpackage by name, and SQL for the same rows where SQL can express them."""

from __future__ import annotations

from meridia.llm import op04_url_trust, op07_winnow
from meridia.llm.op01_gif import op1_gif
from meridia.llm.op02_jaccard import op2_jaccard_join
from meridia.llm.op03_simple8b import op3_simple8b
from meridia.llm.op04_url_trust import op4_url_trust
from meridia.llm.op05_suffix import op5_suffix_dedup
from meridia.llm.op06_quality import op6_quality
from meridia.llm.op07_winnow import op7_winnow
from meridia.llm.op08_language import op8_language
from meridia.llm.op09_piece_bpe import op9_piece_bpe
from meridia.llm.op10_chat import op10_chat

QUERIES = {f.__name__: f for f in (op1_gif, op2_jaccard_join, op3_simple8b, op4_url_trust, op5_suffix_dedup, op6_quality, op7_winnow, op8_language, op9_piece_bpe, op10_chat)}
ORACLES: dict[str, str] = {"op4_url_trust": op04_url_trust.ORACLE, "op7_winnow": op07_winnow.ORACLE}

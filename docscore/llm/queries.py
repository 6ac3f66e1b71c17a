"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from .exact_dedup import OP9_SQL, op9_exact_dedup
from .gif_media import op3_gif_media
from .hard_negatives import op13_hard_negatives
from .html_extract import op7_html_extract
from .minhash_dedup import OP4_SQL, op4_minhash_dedup
from .packing import op2_nnls_packing
from .periodic_runs import op11_periodic_runs
from .pii import op10_pii
from .secret_scan import op8_secret_scan
from .sentencepiece_bpe import op6_sentencepiece
from .suffix_dedup import op1_suffix_array_dedup
from .toxicity import op5_toxicity
from .word_bpe import op12_word_bpe

QUERIES = (
    op1_suffix_array_dedup, op2_nnls_packing, op3_gif_media, op4_minhash_dedup, op5_toxicity,
    op6_sentencepiece, op7_html_extract, op8_secret_scan, op9_exact_dedup, op10_pii,
    op11_periodic_runs, op12_word_bpe, op13_hard_negatives,
)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_dedup": OP4_SQL, "op9_exact_dedup": OP9_SQL}

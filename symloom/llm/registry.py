"""Queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from . import centroids, minhash, warc
from .bpe import op4_bpe
from .centroids import op11_centroids
from .fingerprint import op10_fingerprint
from .html import op7_html
from .langid import op3_language_id
from .media import op2_media
from .minhash import op8_minhash
from .mixing import op12_mixing
from .packing import op6_packing
from .pii import op5_pii
from .token_output import op1_token_output
from .warc import op9_warc

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_media": op2_media,
    "op3_language_id": op3_language_id,
    "op4_bpe": op4_bpe,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_html": op7_html,
    "op8_minhash": op8_minhash,
    "op9_warc": op9_warc,
    "op10_fingerprint": op10_fingerprint,
    "op11_centroids": op11_centroids,
    "op12_mixing": op12_mixing,
}

ORACLES: dict[str, str] = {"op8_minhash": minhash.ORACLE, "op9_warc": warc.ORACLE, "op11_centroids": centroids.ORACLE}

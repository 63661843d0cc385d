"""The queries of this subpackage, and SQL for those that it can express; tests hold the others against a brute-force version."""

from __future__ import annotations

from prosemill.llm import merkle, warc
from prosemill.llm.align import op13_alignment
from prosemill.llm.ann import op2_neighbours
from prosemill.llm.bpe import op8_bpe
from prosemill.llm.chat import op7_chat
from prosemill.llm.html_text import op3_html
from prosemill.llm.langid import op6_language
from prosemill.llm.merkle import op12_manifest
from prosemill.llm.mixing import op5_mixing
from prosemill.llm.pii import op9_personal_data
from prosemill.llm.secrets import op10_secrets
from prosemill.llm.simhash import op1_simhash
from prosemill.llm.sketch import op4_fingerprints
from prosemill.llm.warc import op11_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_neighbours": op2_neighbours,
    "op3_html": op3_html,
    "op4_fingerprints": op4_fingerprints,
    "op5_mixing": op5_mixing,
    "op6_language": op6_language,
    "op7_chat": op7_chat,
    "op8_bpe": op8_bpe,
    "op9_personal_data": op9_personal_data,
    "op10_secrets": op10_secrets,
    "op11_warc": op11_warc,
    "op12_manifest": op12_manifest,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op11_warc": warc.ORACLE_SQL, "op12_manifest": merkle.ORACLE_SQL}

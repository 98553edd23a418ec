"""The queries of this subpackage and their SQL."""

from .bpe import op4_byte_bpe
from .clusters import OP12_SQL, op12_clusters
from .decontaminate import op6_decontamination
from .language import op3_language_id
from .lines import OP5_SQL, op5_line_dedup
from .mixing import op13_lm_scoring
from .neighbours import op8_neighbours
from .phrases import OP11_SQL, op11_phrases
from .pii import op10_pii
from .quality import op1_quality
from .sharding import OP7_SQL, op7_sharding
from .simhash import op2_simhash
from .training_order import op9_training_order

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_simhash, op3_language_id, op4_byte_bpe, op5_line_dedup,
        op6_decontamination, op7_sharding, op8_neighbours, op9_training_order, op10_pii,
        op11_phrases, op12_clusters, op13_lm_scoring,
    )
}
ORACLES: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op7_sharding": OP7_SQL, "op11_phrases": OP11_SQL, "op12_clusters": OP12_SQL}

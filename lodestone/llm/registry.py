"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lodestone.llm.ann import op5_multiprobe_lsh
from lodestone.llm.bpe import op2_byte_bpe
from lodestone.llm.clusters import OP11_SQL, op11_kdtree_kmeans
from lodestone.llm.decontaminate import OP1_SQL, op1_benchmark_decontamination
from lodestone.llm.line_dedup import OP9_SQL, op9_line_dedup
from lodestone.llm.neardup import op4_minhash_neardup
from lodestone.llm.passages import op8_collinear_chaining
from lodestone.llm.pseudonyms import op7_feistel_pseudonyms
from lodestone.llm.quality import op3_cotraining_quality
from lodestone.llm.resample import OP12_SQL, op12_importance_resampling
from lodestone.llm.reshard import op6_mincostflow_resharding
from lodestone.llm.secrets import OP13_SQL, op13_secret_ownership
from lodestone.llm.toxicity import op10_toxicity_cnn

QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_byte_bpe, op3_cotraining_quality, op4_minhash_neardup, op5_multiprobe_lsh, op6_mincostflow_resharding, op7_feistel_pseudonyms, op8_collinear_chaining, op9_line_dedup, op10_toxicity_cnn, op11_kdtree_kmeans, op12_importance_resampling, op13_secret_ownership)}
SQL = {"op1_benchmark_decontamination": OP1_SQL, "op9_line_dedup": OP9_SQL, "op11_kdtree_kmeans": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_secret_ownership": OP13_SQL}

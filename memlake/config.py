"""Result-deciding constants, kept in one frozen object and passed to the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Importance bands and the order the reference semantics give them.
IMPORTANCE_RANK = {"S": 5, "A": 4, "B": 3, "C": 2, "D": 1}
IMPORTANCE_BOOST = {"S": 0.3, "A": 0.2, "B": 0.1, "C": 0.05, "D": 0.0}
EMOTIONS = ("anger", "fear", "joy", "sadness", "surprise", "disgust", "trust", "anticipation")

# Intent word lists and the hard-intent patterns.
ENTITY_TERMS = (
    "谁", "人物", "角色", "轨迹", "做过什么", "干什么", "和谁", "跟谁",
    "where", "who", "character", "person",
)
EMOTION_TERMS = (
    "感觉", "心情", "情绪", "害怕", "开心", "难过", "生气", "喜欢", "讨厌",
    "feel", "emotion", "mood", "afraid", "happy", "sad", "angry",
)
FACT_TERMS = (
    "什么时候", "哪里", "为什么", "怎么", "多少", "是不是", "发生了",
    "when", "why", "how", "what", "fact",
)
ENTITY_PATTERN = "谁|人物|角色|轨迹|做过什么|干什么|where|who|character|person"
EMOTION_PATTERN = "感觉|心情|情绪|害怕|开心|难过|feel|emotion|mood|afraid|happy|sad"

# Names that are placeholders rather than people.
PLACEHOLDER_NAMES = ("null", "none", "unknown", "核心用户", "未知角色")
UNKNOWN_PREFIX = "未知人物_"

# Cognitive relation labels.
RELATIONS = (
    "CAUSALITY", "PROTOTYPE_INVARIANT", "TEMPORAL_CHRONO",
    "COGNITIVE_DIALECTIC", "MERONYMY", "NONE",
)

# Markers kept in the fired-subset table so a failed subset is not retried.
MARK_INCOHERENT = "__skipped_narrative_coherence__"
MARK_FAILED = "__skipped_synthesis_llm_failure__"
MARK_NOOP = "__skipped_abstraction_mining_noop__"

# Pipeline phases, their time limits in ms and channels.
PHASE_LIMIT_MS = {
    "rag_search": 200.0, "recall_assembly": 500.0,
    "abstraction_mining": 2000.0, "narrative_dedupe": 300.0,
}
DEFAULT_PHASE_LIMIT_MS = 200.0
RECALL_PHASES = ("rag_search", "recall_assembly")
ABSTRACT_PHASES = ("abstraction_mining", "narrative_dedupe")


# The default numbers, in the order of the settings they stand for.
@dataclass(frozen=True)
class MemoryConfig:
    context_window: int = 88000
    chars_per_token: float = 1.5
    unclosed_force_ratio: float = 1.2
    split_target: float = 0.8
    split_min: float = 0.7
    split_max: float = 0.9
    split_tolerance: float = 0.05
    prefix_max_depth: int = 3
    fuse_min_chars: int = 35
    max_levels: int = 10
    arousal_gamma: float = 2.0
    half_life_days: float = 60.0
    recall_half_life_days: float = 30.0
    silence_threshold: float = 0.02
    stale_hours: int = 24
    recall_capacity: int = 1000
    global_ratio: float = 0.7
    n_results: int = 60
    older_results: int = 40
    shadow_cap: int = 1200
    intermediate_factor: float = 1.2
    head_ratio: float = 0.66
    min_summary_chars: int = 20
    stub_chars: int = 40
    compress_rounds: int = 20
    pick_budget: int = 9999
    default_offset: int = 0
    primary_shift: int = 1
    minor_shift: int = 1
    prefix_score_factor: float = 0.9
    min_size: int = 6
    min_support: int = 12
    escalated_support: int = 13
    escalate_after: int = 2
    recent_k: int = 1000
    min_recent_k: int = 200
    support_decay: float = 0.01
    max_rounds: int = 256
    coherence_min: int = 3
    coverage_strength: float = 1.0
    coverage_max: float = 3.0
    coverage_decay: float = 2.0
    audit_every: int = 10
    ema_alpha: float = 0.25
    quality_weight: float = 0.1
    cap_base: float = 2.0
    cap_floor: float = 0.45
    cap_ceiling: float = 2.0
    cap_sensitivity: float = 0.08
    cap_neutral: float = 0.5
    hit_percentile: float = 90.0
    compress_target: float = 0.1515
    summary_decay: float = 0.5
    snapshot_decay: float = 0.6
    summary_share: float = 0.40
    snapshot_share: float = 0.25
    wp_share: float = 0.25
    decoration_share: float = 0.10
    affect_decay_per_hour: float = 0.1
    energy_trigger: float = 5.0
    habituation: float = 0.01
    surviving_share: float = 0.6
    surviving_share_loaded: float = 0.4
    affect_history: int = 10
    energy_gain: float = 1.0
    rrf_k: int = 60
    factor_alpha: float = 0.5
    mood_beta: float = 0.2
    reinforce: float = 1.5
    factor_cap: float = 300.0
    perf_window: int = 32
    load_max: float = 4.0
    dup_overlap: float = 0.9
    dup_novelty_ratio: float = 0.1
    dup_novelty_abs: int = 2
    dup_recent_k: int = 200
    dup_min_recent_k: int = 20
    weights_fact: tuple[float, float, float] = (0.7, 0.1, 0.2)
    weights_emotion: tuple[float, float, float] = (0.2, 0.6, 0.2)
    weights_entity: tuple[float, float, float] = (0.1, 0.0, 0.9)
    intent_temperature: float = 1.0
    intent_prototype_weight: float = 2.0
    intent_fact_baseline: float = 1.0
    vector_dim: int = 512
    pool_base: int = 100000
    pool_min: int = 20000
    bypass_threshold: float = 0.5
    bypass_per_minute: int = 1
    immune_arousal: float = 0.8
    dream_batch: int = 5
    timeline_top: int = 20
    conflict_top: int = 50
    conflict_product: float = -0.2
    shadow_lambda: float = 0.5
    tombstone_prefix: str = "[TOMBSTONE]"

    @property
    def context_chars(self) -> float:
        return self.context_window * self.chars_per_token

    @property
    def len_msg(self) -> int:
        return int(self.context_chars / 66)

    @property
    def redline(self) -> int:
        return int(self.context_chars * 10 / 66)

    @property
    def safe_watermark(self) -> int:
        return int(self.context_chars * 2 / 66)

    @property
    def role_capacity(self) -> int:
        return int(self.context_chars / 6.6)

    @property
    def force_threshold(self) -> int:
        return int(self.len_msg * self.unclosed_force_ratio)


DEFAULT = MemoryConfig()

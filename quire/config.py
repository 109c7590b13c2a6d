"""Settings and word lists. Nothing reads the environment; callers pass a RetrievalConfig."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 8
    candidate_k: int = 80
    context_tokens: int = 6000
    min_score: float = 0.10
    chunk_chars: int = 800
    overlap_sentences: int = 2
    semantic_weight: float = 0.70
    lexical_weight: float = 0.30
    fusion_bonus: float = 0.03
    rerank_window: int = 12
    cross_window: int = 20
    cross_chars: int = 1800
    per_document: int = 2
    k1: float = 1.5
    b: float = 0.75


# Results depend on these words, units, patterns and thresholds.
STOP_WORDS = ("avec", "dans", "des", "du", "elle", "est", "les", "leur", "leurs", "mais", "par", "pas", "plus", "pour", "que", "qui", "quoi", "sont", "sur", "une", "aux", "ces", "ses", "the", "and", "for", "with")
TECHNICAL_HINTS = ("liste", "consommation", "consommations", "electrique", "électrique", "watts", "watt", "puissance", "spec", "specification", "spécification", "capacite", "capacites", "capacité", "capacités", "volumetrie", "volumetries", "volumétrie", "volumétries", "capacity", "capacities", "raw", "effective", "usable", "dimensions")
PORTFOLIO_WORDS = ("toutes", "tous", "portfolio", "portefeuille", "solutions")
CAPACITY_WORDS = ("volumetrie", "volumetries", "volumétrie", "volumétries", "capacite", "capacites", "capacité", "capacités", "capacity", "capacities")
SYNTHESIS_WORDS = ("liste", "lister", "toutes", "tous", "compare", "comparaison", "synthese", "synthèse", "avantages", "inconvenients", "inconvénients", "resume", "résume")
POWER_WORDS = ("consommation", "consomamtion", "electrique", "électrique", "watts", "watt", "puissance")
UNITS = ("watts", "watt", "tb", "tib", "pb", "pib", "gb/s", "iops", "latency", "physical", "technical specifications")
UNKNOWN_SIGNALS = ("je ne sais pas", "ne permet pas", "pas d'information", "aucune information", "not enough information", "i don't know", "cannot answer")
BOILERPLATE_LINES = ("table of contents", "contents")
TITLE_PREFIX = "TITRE DE SECTION: "
TABLE_PREFIX = "TABLEAU extrait de la page "
TABLE_TITLE, EXTRACT_TITLE = "Tableau", "Extrait technique"
EXTRACT_PREFIX = "EXTRAIT TECHNIQUE page "
EXPANSION_LEAD = "\n\nTermes de recherche additionnels : "
LABELS = ("question originale", "reformulation LLM", "expansion synonymes")
TITLE_UNIT = r"\d\s*(?:TB|TiB|PB|PiB|GB/s|IOPS|W|watts?)\b"
VALUE_PATTERN = r"\d[\d,.\s–-]*(?:watts?|w|pb|pib|tb|tib|gb/s|gb|iops|ms|µs|us|sla|u)\b"
REWRITE_CHARS = 600
TRUE_WORDS = ("1", "true", "yes", "oui", "on")
ADAPTIVE = (  # branch, least top_k, least candidate_k, most min_score; the first that applies wins
    ("inventory", 12, 180, 0.0),
    ("portfolio", 12, 160, 0.0),
    ("technical", 8, 120, 0.0),
    ("synthesis", 10, 120, 0.05),
    ("standard", 0, 60, 1.0),
)

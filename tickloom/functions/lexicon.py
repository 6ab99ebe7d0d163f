"""Fixed values of the headline grammar."""

# Topic phrases.
TOPICS = [
    "enterprise software",
    "cloud infrastructure",
    "data analytics",
    "digital payments",
    "wireless connectivity",
    "supply chain optimization",
    "precision manufacturing",
    "process automation",
    "renewable storage",
    "automated logistics",
]

# Geography names.
GEOGRAPHIES = [
    "North America",
    "Latin America",
    "Middle East",
    "Asia Pacific",
    "Central Europe",
    "Europe",
    "Scandinavia",
    "Southeast Asia",
]

# Counterparties.
COUNTERPARTIES = [
    "a global retailer",
    "a multinational manufacturer",
    "a national infrastructure agency",
    "a leading cloud platform",
    "a top-tier research institute",
    "a major logistics provider",
    "an international consortium",
]

# Words that open the event part of a headline.
EVENT_STARTERS = [
    "chief operating officer",
    "chief strategy officer",
    "to present",
    "to host",
    "secures",
    "reports",
    "sees",
    "announces",
    "faces",
    "files",
    "completes",
    "begins",
    "explores",
    "launches",
    "delays",
    "revises",
    "misses",
    "wins",
    "names",
    "recalls",
    "withdraws",
    "warns",
    "opens",
    "confirms",
    "raises",
    "loses",
    "enters",
    "achieves",
    "expands",
    "signs",
    "beats",
    "cfo",
]

# Event rules as (event family, verb family, polarity, fragments); the first match wins.
EVENT_RULES = [
    ("class_action", "faces", -1, ("faces class action",)),
    ("regulatory_review", "faces", -1, ("faces regulatory review",)),
    ("regulatory_approval", "files", 1, ("files for regulatory approval",)),
    ("record_revenue", "reports", 1, ("record quarterly revenue",)),
    ("operating_income_decline", "reports", -1, ("decline in operating income",)),
    ("customer_acquisition_increase", "reports", 1, ("increase in customer acquisition",)),
    ("strong_demand", "reports", 1, ("reports strong demand",)),
    ("rising_costs", "reports", -1, ("reports rising costs pressuring margins",)),
    ("regional_revenue_decline", "reports", -1, ("reports unexpected decline in", "revenue")),
    ("margin_improvement", "sees", 1, ("margin improvement",)),
    ("new_customer_orders_drop", "sees", -1, ("drop in new customer orders",)),
    ("mixed_results", "sees", 0, ("mixed results",)),
    ("share_buyback", "announces", 1, ("share buyback program",)),
    ("breakthrough", "announces", 1, ("announces breakthrough",)),
    ("capex_plan", "announces", 0, ("capital expenditure plan",)),
    ("strategic_acquisition", "completes", 1, ("completes strategic acquisition",)),
    ("facility_upgrade", "completes", 0, ("completes planned facility upgrade",)),
    ("scheduled_maintenance", "begins", 0, ("begins scheduled maintenance",)),
    ("strategic_alternatives", "explores", 0, ("explores strategic alternatives",)),
    ("next_generation_launch", "launches", 1, ("launches next-generation",)),
    ("product_launch_delay", "delays", -1, ("delays product launch",)),
    ("strategy_revision", "revises", 0, ("revises long-term strategy",)),
    ("revenue_miss", "misses", -1, ("misses quarterly revenue estimates",)),
    ("industry_award", "wins", 1, ("wins industry award",)),
    ("new_head", "names", 0, ("names new head of",)),
    ("product_recall", "recalls", -1, ("recalls products in",)),
    ("market_withdrawal", "withdraws", -1, ("withdraws from",)),
    ("supply_chain_warning", "warns", -1, ("warns of supply chain disruptions",)),
    ("new_office", "opens", 0, ("opens new office in",)),
    ("conference_presentation", "to_present", 0, ("to present at",)),
    ("symposium_participation", "confirms", 0, ("confirms participation in",)),
    ("investor_day", "to_host", 0, ("to host investor day",)),
    ("executive_departure", "cfo", -1, ("steps down unexpectedly",)),
    ("executive_departure", "chief_operating_officer", -1, ("steps down unexpectedly",)),
    ("executive_open_letter", "cfo", -1, ("addresses investor concerns in open letter",)),
    ("executive_open_letter", "chief_strategy_officer", -1, ("addresses investor concerns in open letter",)),
    ("loses_key_contract", "loses", -1, ("loses key contract",)),
    ("guidance_raise", "raises", 1, ("raises full-year guidance",)),
    ("joint_venture", "enters", 1, ("enters joint venture",)),
    ("partnership", "signs", 1, ("signs multi-year partnership",)),
    ("regulatory_milestone", "achieves", 1, ("achieves key regulatory milestone",)),
    ("market_expansion", "expands", 1, ("expands operations into",)),
    ("contract_win", "secures", 1, ("secures", "contract with")),
    ("beats_expectations", "beats", 1, ("beats analyst expectations",)),
]

# Polarity of a verb when no event rule matches (verbs not listed are neutral).
DEFAULT_POLARITY_BY_VERB = {
    "secures": 1,
    "reports": 0,
    "sees": 0,
    "announces": 0,
    "faces": -1,
    "files": 0,
    "completes": 0,
    "begins": 0,
    "explores": 0,
    "launches": 1,
    "delays": -1,
    "revises": 0,
    "misses": -1,
    "wins": 1,
    "names": 0,
    "recalls": -1,
    "withdraws": -1,
    "warns": -1,
    "opens": 0,
    "confirms": 0,
    "to_present": 0,
    "to_host": 0,
    "chief_operating_officer": -1,
    "chief_strategy_officer": -1,
    "cfo": -1,
    "raises": 1,
    "loses": -1,
    "enters": 1,
    "achieves": 1,
    "expands": 1,
    "signs": 1,
    "beats": 1,
}

# Opening phrases that form one verb family.
VERB_PHRASES = ["chief operating officer", "chief strategy officer", "to present", "to host"]

# Patterns.
AMOUNT_PATTERN = r"\$(\d+(?:\.\d+)?)([MB])"
PERCENT_PATTERN = r"(\d+(?:\.\d+)?)%"
TOKEN_PATTERN = r"[a-z0-9]+"

"""Fixed schemas and fixed values of the data model."""

from __future__ import annotations

#: Columns that every memory plane has, as Spark DDL.
BASE = (
    "object_id string, namespace string, identity_family string, schema_version int, state string, version int, "
    "created_epoch double, updated_epoch double, content string, summary string, title string, tags array<string>, topics array<string>, "
    "importance int, reinforcement_count int, access_count int, valid_from_epoch double, valid_until_epoch double, "
    "superseded_by string, supported_by array<string>"
)
PLANES = ("episodic", "curated", "concept", "artifact", "artifact_chunks", "thought", "lifecycle_events")

# --- fixed values ---------------------------------------------------------------------------
#: States that each plane's rows may have.
ALLOWED_STATES = {
    "episodic": ("provisional", "matured", "demoted", "archived", "superseded"),
    "concept": ("synthesized", "matured", "promoted", "demoted", "superseded"),
    "curated": ("matured", "superseded", "archived"),
    "artifact": ("matured", "archived", "superseded"),
    "thought": ("provisional", "matured", "archived"),
}
#: Legal lifecycle transitions by object type: from state -> to states.
TRANSITIONS = {
    "episodic": {
        "provisional": ("matured", "archived"),
        "matured": ("demoted", "superseded"),
        "demoted": ("matured",),
        "archived": ("matured",),
        "superseded": (),
    },
    "curated": {"matured": ("superseded", "archived"), "superseded": (), "archived": ("matured",)},
    "concept": {
        "synthesized": ("matured",),
        "matured": ("promoted", "demoted", "superseded"),
        "promoted": (),
        "demoted": ("matured",),
        "superseded": (),
    },
    "artifact": {"matured": ("archived", "superseded"), "archived": (), "superseded": ()},
    "thought": {"provisional": ("matured", "archived"), "matured": ("archived",), "archived": ()},
}
#: Provenance score by plane and state; other pairs score PROVENANCE_DEFAULT.
PROVENANCE = {
    ("curated", "matured"): 1.0,
    ("curated", "superseded"): 0.6,
    ("concept", "promoted"): 0.9,
    ("concept", "matured"): 0.6,
    ("concept", "synthesized"): 0.35,
    ("episodic", "matured"): 0.5,
    ("episodic", "provisional"): 0.2,
    ("artifact_chunk", "matured"): 0.7,
}
PROVENANCE_DEFAULT = 0.1
HALF_LIFE_DAYS = {"curated": 180.0}
HALF_LIFE_DEFAULT_DAYS = 30.0
#: Weights of relevance, recency, importance, provenance and reinforcement.
WEIGHTS = (0.55, 0.15, 0.10, 0.15, 0.05)
#: Visible states by retrieval mode.
RANKED_STATES = ("matured", "promoted")
RECENT_STATES = ("provisional", "matured", "promoted")
ARCHIVE_STATES = ("demoted", "archived", "superseded")
#: Similarity from which a capture may be a duplicate, by plane; planes left out never probe.
DUPLICATE_THRESHOLDS = {"episodic": 0.92, "concept": 0.85, "artifact_chunks": 0.98}
SUPERSESSION_HINTS = ("update:", "correction:", "replacing:")
#: Priorities and display groups of context items, by kind and by staleness.
KIND_PRIORITY = {
    "boundary": 10.0,
    "operating-rule": 9.0,
    "identity-principle": 8.0,
    "relationship/care-cue": 7.0,
    "open-loop": 6.0,
    "project-stance": 5.0,
    "tool/runtime-fact": 4.5,
    "correction/suppression": 4.0,
    "episode": 1.0,
}
STALENESS_PRIORITY = {"durable": 4.0, "current": 3.0, "episodic": 1.0, "superseded": -8.0}
KIND_GROUP = {
    "boundary": "Must-Obey",
    "operating-rule": "Must-Obey",
    "identity-principle": "Relationship-Voice",
    "relationship/care-cue": "Relationship-Voice",
    "project-stance": "Current-Project",
    "open-loop": "Open-Loops",
    "tool/runtime-fact": "Tool-Runtime",
    "correction/suppression": "Recent-Corrections",
    "episode": "Context",
}
GROUP_ORDER = ("Must-Obey", "Current-Project", "Relationship-Voice", "Open-Loops", "Tool-Runtime", "Recent-Corrections", "Context")
#: Requests per minute and bucket; operators get OPERATOR_FACTOR times as many.
RATE_LIMITS = {"capture": 100, "thought": 100, "artifact-upload": 20, "batch-write": 50, "transition": 50, "default": 200}
OPERATOR_FACTOR = 10
#: Floors of the retrieval metrics by mode.
METRIC_FLOORS = {
    ("fast", "ndcg_at_10"): 0.55,
    ("fast", "mrr"): 0.55,
    ("fast", "recall_at_20"): 0.70,
    ("fast", "p_at_1"): 0.40,
    ("deep", "ndcg_at_10"): 0.65,
    ("deep", "mrr"): 0.70,
    ("deep", "recall_at_20"): 0.85,
    ("deep", "p_at_1"): 0.55,
}

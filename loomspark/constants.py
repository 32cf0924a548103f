"""Thresholds of the analyses."""

MIN_GEM_DECKS, MAX_GEM_SHARE, GEM_TOP_CUT, MAX_GEM_LUCK = 5, 0.15, 0.20, 0.010
PILOT_ICC, MIN_GEM_SLICE, MAX_GEM_NODES, RENDER_THRESHOLD = 0.226, 34, 250, 250
TOP_PARTNERS, LAND_TYPE = 15, "Lands"
MIN_PILOT_YEAR_EVENTS, MIN_QUALIFYING_YEARS = 2, 2
MIN_SHARED_EVENTS, MIN_ARCHETYPE_EVENTS, MIN_LANDSCAPE_ARCHETYPES = 2, 2, 3
MAJOR_FIELD_SIZE, MIN_FIELD_COVERAGE = 64, 0.5
MIN_CAREER_MAJORS, MIN_RECENT_MAJORS, RACE_RECENCY_MONTHS = 5, 2, 12
RACE_STEP_MONTHS, RACE_POINTS, MIN_SCORED_MAJORS = 6, 5, 2
RACE_RESAMPLES, RACE_SEED, RACE_INTERVAL, MIN_RACE_CONTENDERS = 1000, 20260727, 0.90, 2
INTERVAL_Z, MIN_SPREAD_FINISHES = 1.645, 5
MIN_CUT_FIELD = 24
GOLDEN_TOLERANCE = 1e-9
COLOURS = ("W", "U", "B", "R", "G")

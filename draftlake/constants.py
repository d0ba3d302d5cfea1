"""Fixed values that decide results. They are semantics, not tuning knobs."""

# Units.
MM_PER_INCH = 25.4

# Scale fitting (ratios are px per printed unit).
SCALE_REL_TOL = 0.04
SCALE_ABS_PX = 2.5
SCALE_MIN_READINGS = 3
VIEW_MIN_READINGS = 2

# Binding of printed numbers to ink, in px.
ANCHOR_TOL_PX = 3.5
FEATURE_TOL_PX = 4.0
AXIS_TOL_PX = 3.0
FEATURES_PER_SITE = 4
ALIGNED_PER_ANCHOR = 8
CHAIN_HOPS = 4
ROW_RESIDUAL_LIMIT = 0.25
ROW_FIT = 0.05
FEATURE_RANK = {
    "circle-centre": 0,
    "arc-centre": 1,
    "circle-rim": 2,
    "arc-rim": 3,
    "line-end": 4,
    "path-vertex": 5,
}

# Claims.
CLAIM_REL_TOL = 0.03
CLAIM_ABS_MM = 0.15
CLAIM_CANDIDATES = 6
CROSSED_CANDIDATES = 4
CLAIM_ALTERNATIVES = 3
COUNT_RADIUS_PX = 260.0

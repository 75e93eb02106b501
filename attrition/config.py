"""Parameters and fixed values of the churn model.

Everything that must equal the original program's values for results to
match lives here, stated plainly.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values --------------------------------------------------------
# Canonical page list (the pivot columns of the daily table), in order.
PAGES = [
    "NextSong",
    "Thumbs Up",
    "Thumbs Down",
    "Add to Playlist",
    "Add Friend",
    "Help",
    "Error",
    "Downgrade",
    "Submit Downgrade",
    "Home",
    "Roll Advert",
]

CHURN_PAGE = "Submit Downgrade"
SUBSCRIBE_PAGE = "Submit Upgrade"

# Model input columns, in model order, for recent_window=7 / long_window=14.
FEATURES = [
    "days_since_join",
    "gender_code",
    "day_of_month",
    "day_of_week",
    "dow_sin",
    "dow_cos",
    "dom_sin",
    "dom_cos",
    "artist_entropy_day",
    "cum_events",
    "cum_listen_sec",
    "cum_NextSong",
    "cum_Thumbs Up",
    "cum_Thumbs Down",
    "cum_Add to Playlist",
    "cum_Add Friend",
    "win7_events",
    "win7_listen_sec",
    "win7_NextSong",
    "win7_Thumbs Up",
    "win7_Thumbs Down",
    "win7_Add to Playlist",
    "win7_Add Friend",
    "ratio_thumbs_up",
    "ratio_playlist",
    "ratio_friend",
    "ratio7_thumbs_up",
    "ratio7_playlist",
    "ratio7_friend",
    "chg_thumbs_up",
    "chg_playlist",
    "chg_friend",
    "win7_error_rate",
    "win7_help_rate",
    "downgrade_wo_submit",
    "prop_nextsong",
    "win14_events",
    "win14_listen_sec",
    "win14_NextSong",
    "win14_Thumbs Up",
    "win14_Thumbs Down",
    "win14_Add to Playlist",
    "win14_Add Friend",
    "ratio14_thumbs_up",
    "ratio14_playlist",
    "ratio14_friend",
    "delta7_14_thumbs",
    "delta7_14_playlist",
]

# Browser and OS tokens, first match wins.
BROWSER_PATTERN = r"(Firefox|Chrome|Safari|Edge|MSIE|Opera)"
OS_PATTERN = r"(Windows|Macintosh|Linux|iPhone|Android)"

WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# --- end of fixed values -------------------------------------------------

LABEL = "label_churn_horizon"
CORE_COLUMNS = ["events", "listen_sec"] + PAGES


@dataclass(frozen=True)
class Params:
    """Model parameters; defaults are the shipped configuration."""

    horizon_days: int = 5
    recent_window: int = 7
    long_window: int = 14
    precision_floor: float = 0.7
    scale_pos_weight: float | None = None  # None: derive from the data
    rounds: int = 1000  # boosted trees
    max_depth: int = 6
    learning_rate: float = 0.05
    row_share: float = 0.8  # rows that each tree sees
    column_share: float = 0.8  # features that each tree may use
    min_child_weight: float = 2.0  # Hessian of a leaf, at least
    reg_lambda: float = 1.0
    gamma: float = 0.0  # gain of a split, more than this
    max_bins: int = 256
    seed: int = 42


def feature_names(params: Params = Params()) -> list[str]:
    """FEATURES renamed for non-default window lengths."""
    s, l = params.recent_window, params.long_window
    out = []
    for name in FEATURES:
        name = (
            name.replace("delta7_14_", f"delta{s}_{l}_")
            .replace("win14_", f"win{l}_")
            .replace("ratio14_", f"ratio{l}_")
            .replace("win7_", f"win{s}_")
            .replace("ratio7_", f"ratio{s}_")
        )
        out.append(name)
    return out

"""Feature configuration: the fixed catalogue of variables and pressure levels.

The values below are fixed values of the model configuration and must stay as
listed (variable order and level order define the catalogue index).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
PRESSURE_LEVELS = [50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000]
ATMOSPHERIC = ["geopotential", "wind_x", "wind_y", "wind_z", "specific_humidity", "temperature"]
SURFACE = [
    "wind_x_10m",
    "wind_y_10m",
    "2m_temperature",
    "mean_sea_level_pressure",
    "surface_pressure",
    "total_column_water",
    "total_precipitation_6hr",
]
FORCINGS = [
    "toa_incident_solar_radiation",
    "sin_time_of_day",
    "cos_time_of_day",
    "sin_year_progress",
    "cos_year_progress",
]
CONSTANTS = [
    "geopotential_at_surface",
    "land_sea_mask",
    "slope_of_sub_gridscale_orography",
    "standard_deviation_of_orography",
    "latitude",
    "longitude",
]
# Constants normalised with a z-score (the land-sea mask stays raw).
ZSCORE_CONSTANTS = [
    "geopotential_at_surface",
    "slope_of_sub_gridscale_orography",
    "standard_deviation_of_orography",
]
# Raw variables kept by preprocessing (the allow-list).
KEEP_VARIABLES = [
    "10m_u_component_of_wind",
    "10m_v_component_of_wind",
    "2m_temperature",
    "mean_sea_level_pressure",
    "surface_pressure",
    "temperature",
    "land_sea_mask",
    "time",
    "u_component_of_wind",
    "v_component_of_wind",
    "vertical_velocity",
    "level",
    "specific_humidity",
    "geopotential",
    "latitude",
    "longitude",
    "geopotential_at_surface",
    "total_precipitation_6hr",
    "total_column_water",
    "standard_deviation_of_orography",
    "slope_of_sub_gridscale_orography",
    "wind_x",
    "wind_y",
    "wind_z",
    "wind_x_10m",
    "wind_y_10m",
]
# Features plotted/monitored during training.
MONITOR_FEATURES = [
    "geopotential_h500",
    "geopotential_h850",
    "temperature_h500",
    "temperature_h850",
    "wind_x_h500",
    "wind_x_h850",
    "total_precipitation_6hr",
]
# Loss weights per variable (atmospheric 1.0, surface 0.1).
VARIABLE_LOSS_WEIGHTS = {
    **{v: 1.0 for v in ATMOSPHERIC},
    **{v: 0.1 for v in SURFACE},
}
# Evaluation switch of the comparison config: enabled levels and variables.
EVAL_LEVELS = {850: True}
EVAL_VARIABLES = {
    "geopotential": True,
    "wind_x": False,
    "wind_y": False,
    "wind_z": False,
    "specific_humidity": True,
    "temperature": False,
    "wind_x_10m": True,
    "wind_y_10m": True,
    "2m_temperature": True,
    "mean_sea_level_pressure": False,
    "surface_pressure": False,
    "total_column_water": False,
    "total_precipitation_6hr": True,
}
# Export mapping: variable -> (short name, level code, scale, offset); value * scale + offset.
EXPORT_UNITS = [
    ("10m_u_component_of_wind", "UU", 75597472, 1.94384, 0.0),
    ("10m_v_component_of_wind", "VV", 75597472, 1.94384, 0.0),
    ("2m_temperature", "TT", 76696048, 1.0, -273.15),
    ("geopotential", "GZ", None, 1.0 / 98.1, 0.0),
    ("geopotential_at_surface", "GZ", None, 1.0 / 98.1, 0.0),
    ("land_sea_mask", "MG", None, 1.0, 0.0),
    ("mean_sea_level_pressure", "PN", None, 1.0 / 100, 0.0),
    ("specific_humidity", "HU", None, 1.0, 0.0),
    ("temperature", "TT", None, 1.0, -273.15),
    ("total_precipitation_6hr", "PR", None, 1.0 / 1000, 0.0),
    ("u_component_of_wind", "UU", None, 1.94384, 0.0),
    ("v_component_of_wind", "VV", None, 1.94384, 0.0),
    ("vertical_velocity", "WW", None, 1.0, 0.0),
    ("surface_pressure", "P0", None, 1.0 / 100, 0.0),
    ("total_column_water", "CQ1", None, 1.0, 0.0),
]
GRAVITY = 9.80616          # m s-2, wind conversion
GAS_CONSTANT_DRY = 287.05  # J kg-1 K-1
GRAVITY_DISPLAY = 9.80665  # geopotential -> height for display
SOLAR_CONSTANT = 1360.56   # W m-2
TIME_RESOLUTION_H = 6
DIFFUSION_STEPS = 1000
BETA_START, BETA_END = 1e-4, 0.02
HUMIDITY_EPS = 1e-12
PRECIP_EPS, PRECIP_SHIFT = 1e-6, 10.0
# --- end fixed values ---------------------------------------------------------


@dataclass(frozen=True)
class FeatureConfig:
    """Typed replacement for the YAML feature tree."""

    levels: list = field(default_factory=lambda: list(PRESSURE_LEVELS))
    atmospheric: list = field(default_factory=lambda: list(ATMOSPHERIC))
    surface: list = field(default_factory=lambda: list(SURFACE))
    in_atmospheric: list | None = None
    in_surface: list | None = None
    forcings: list = field(default_factory=lambda: list(FORCINGS))
    constants: list = field(default_factory=lambda: list(CONSTANTS))

    def feature_names(self, atmospheric=None, surface=None) -> list:
        atm = self.atmospheric if atmospheric is None else atmospheric
        sur = self.surface if surface is None else surface
        return [f"{v}_h{lv}" for v in atm for lv in self.levels] + list(sur)

    @property
    def outputs(self) -> list:
        return self.feature_names()

    @property
    def inputs(self) -> list:
        return self.feature_names(self.in_atmospheric, self.in_surface)

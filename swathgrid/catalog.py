"""Grids, projections and the instruments' variables, as plain data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Grid:
    name: str
    epsg: int
    x_min: float
    y_max: float
    res: float
    n_cols: int
    n_rows: int
    lat_min: float
    lat_max: float | None = None

    @property
    def family(self) -> str:
        return self.name.split("_")[0]

    @property
    def projection(self) -> str:
        """The projection that the grid is laid out in."""
        letter = self.name.split("_")[1][0]
        return {"EASE2": letter, "STEREO": f"PS_{letter}", "MERC": "MERC_G"}[self.family]

    def step(self, axis: str) -> float:
        """Distance of cell centres: the resolution, or for Mercator what divides the box into whole steps."""
        if self.family != "MERC":
            return self.res
        span = -2 * self.x_min if axis == "x" else 2 * self.y_max
        return span / int(span / self.res)

    def first(self, axis: str) -> float:
        """Centre of the first column or row; Mercator axes begin on the box's edge."""
        half = 0.0 if self.family == "MERC" else self.res / 2
        return self.x_min + half if axis == "x" else self.y_max - half


_M = (-20037508.342789244, 19929239.11337915)
_GLOBAL = (-17367530.44, 7314540.83)

#: Fixed values of the public EASE-Grid 2.0, NSIDC polar stereographic and World Mercator grids.
GRIDS = {
    g.name: g
    for g in (
        Grid("EASE2_G1km", 6933, *_GLOBAL, 1000.9, 34704, 14616, -86, 86),
        Grid("EASE2_G3km", 6933, *_GLOBAL, 3002.69, 11568, 4872, -86, 86),
        Grid("EASE2_G9km", 6933, *_GLOBAL, 9008.05, 3856, 1624, -86, 86),
        Grid("EASE2_G36km", 6933, *_GLOBAL, 36032.22, 964, 406, -86, 86),
        Grid("EASE2_N1km", 6931, -9e6, 9e6, 1000.0, 18000, 18000, 0),
        Grid("EASE2_N3km", 6931, -9e6, 9e6, 3000.0, 6000, 6000, 0),
        Grid("EASE2_N9km", 6931, -9e6, 9e6, 9000.0, 2000, 2000, 0),
        Grid("EASE2_N36km", 6931, -9e6, 9e6, 36000.0, 500, 500, 0),
        Grid("EASE2_S3km", 6932, -9e6, 9e6, 3000.0, 6000, 6000, 0),
        Grid("EASE2_S9km", 6932, -9e6, 9e6, 9000.0, 2000, 2000, 0),
        Grid("EASE2_S36km", 6932, -9e6, 9e6, 36000.0, 500, 500, 0),
        Grid("STEREO_N6.25km", 3413, -3850000.0, 5850000.0, 6250.0, 1216, 1792, 60),
        Grid("STEREO_N12.5km", 3413, -3850000.0, 5850000.0, 12500.0, 608, 896, 60),
        Grid("STEREO_N25km", 3413, -3850000.0, 5850000.0, 25000.0, 304, 448, 60),
        Grid("STEREO_S6.25km", 3976, -3950000.0, 4350000.0, 6250.0, 1264, 1328, -60),
        Grid("STEREO_S12.5km", 3976, -3950000.0, 4350000.0, 12500.0, 632, 664, -60),
        Grid("STEREO_S25km", 3976, -3950000.0, 4350000.0, 25000.0, 316, 332, -60),
        Grid("MERC_G25km", 3395, *_M, 25000.0, 1604, 1595, -85, 85),
        Grid("MERC_G12.5km", 3395, *_M, 12500.0, 3207, 3189, -85, 85),
        Grid("MERC_G6.25km", 3395, *_M, 6250.0, 6413, 6378, -85, 85),
    )
}

#: Which projections a family of grids may be asked for.
FAMILIES = {"EASE2": ("G", "N", "S"), "STEREO": ("PS_N", "PS_S"), "MERC": ("MERC_G",)}
PROJECTIONS = ("G", "N", "S", "PS_N", "PS_S", "UPS_N", "UPS_S", "MERC_G")

ALGORITHMS = ("NN", "DIB", "IDS", "BG", "RSIR", "LW", "CG")

#: Bands of each instrument, and the angles (inclusive, degrees) at which a sample looks aft.
BANDS = {"SMAP": ("L",), "AMSR2": ("6", "7", "10", "18", "23", "36", "89a", "89b"), "CIMR": ("L", "C", "X", "K", "KA")}
AFT = {"SMAP": (90.0, 270.0), "CIMR": (180.0, 360.0)}
HORNS = {"L": 1, "C": 4, "X": 4, "K": 8, "KA": 8}
#: Noise (K) of bands whose files have none.
NEDT = {"L": 0.3, "C": 0.2, "X": 0.3, "KA": 0.4, "K": 0.7}

#: Fixed values, all of them: names in the instruments' files and their canonical names.
COLUMNS = {
    "SMAP": {
        "tb_lon": "longitude", "tb_lat": "latitude", "tb_h": "bt_h", "tb_v": "bt_v", "tb_3": "bt_3", "tb_4": "bt_4",
        "nedt_h": "nedt_h", "nedt_v": "nedt_v", "nedt_3": "nedt_3", "nedt_4": "nedt_4", "antenna_scan_angle": "processing_scan_angle",
        "antenna_earth_azimuth": "azimuth", "faraday_rotation_angle": "faraday_rot_angle", "sc_geodetic_alt_ellipsoid": "altitude",
        "sc_nadir_lon": "sub_satellite_lon", "sc_nadir_lat": "sub_satellite_lat", "x_pos": "x_position", "y_pos": "y_position", "z_pos": "z_position",
        "x_vel": "x_velocity", "y_vel": "y_velocity", "z_vel": "z_velocity", "antenna_scan_qual_flag": "scan_quality_flag",
        "tb_qual_flag_h": "data_quality_h", "tb_qual_flag_v": "data_quality_v", "tb_qual_flag_3": "data_quality_3", "tb_qual_flag_4": "data_quality_4",
    },
    "AMSR2": {"Earth Azimuth": "azimuth", "Sun Azimuth": "solar_azimuth", "Scan Time": "scan_time", "Navigation Data": "navigation"},
    "CIMR": {
        "lon": "longitude", "lat": "latitude", "brightness_temperature_h": "bt_h", "brightness_temperature_v": "bt_v",
        "brightness_temperature_t3": "bt_3", "brightness_temperature_t4": "bt_4", "scan_angle": "processing_scan_angle", "earth_azimuth": "azimuth",
        "OZA": "oza", "SatelliteBody2EarthCenteredInertialFrame": "attitude",
    },
}

#: What canonical columns are made of where files hold vectors or parts of a time (see sources.swath.unfold).
POSITION, VELOCITY = ("x_position", "y_position", "z_position"), ("x_velocity", "y_velocity", "z_velocity")
VECTORS = {"satellite_position": POSITION, "satellite_velocity": VELOCITY, "navigation": POSITION + VELOCITY}
PARTS = {
    **{c: tuple(v for v, names in VECTORS.items() if c in names) for c in POSITION + VELOCITY}, "altitude": ("satellite_position",),
    "acq_time_utc": ("days", "seconds", "microseconds", "scan_time"),
}

QUALITY_FLAGS = ("scan_quality_flag", "data_quality_h", "data_quality_v", "data_quality_3", "data_quality_4")
FILL = -9999.0

#: Variables that may be asked for, by instrument.
VARIABLES = {
    "SMAP": ("bt_h", "bt_v", "bt_3", "bt_4", "processing_scan_angle", "longitude", "latitude", "faraday_rot_angle", "nedt_h", "nedt_v", "nedt_3", "nedt_4", "regridding_n_samples", "regridding_l1b_orphans", "acq_time_utc", "azimuth"),
    "AMSR2": ("bt_h", "bt_v", "longitude", "latitude", "regridding_n_samples", "regridding_l1b_orphans", "x_position", "y_position", "z_position", "x_velocity", "y_velocity", "z_velocity", "azimuth", "solar_azimuth", "acq_time_utc"),
    "CIMR": ("bt_h", "bt_v", "bt_3", "bt_4", "processing_scan_angle", "longitude", "latitude", "nedt_h", "nedt_v", "nedt_3", "nedt_4", "regridding_n_samples", "regridding_l1b_orphans", "acq_time_utc", "azimuth", "oza", "altitude"),
}

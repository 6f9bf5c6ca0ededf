"""Schemas of the radar tables, in one place."""

from __future__ import annotations

#: Field columns of rays; an absent field is a null column, a masked gate a null element.
FIELDS = ("reflectivity", "velocity", "specific_differential_phase", "cross_correlation_ratio", "differential_reflectivity", "spectrum_width")
#: Channel names of chips, in model order.
VARIABLES = {"DBZ": "reflectivity", "VEL": "velocity", "KDP": "specific_differential_phase", "RHOHV": "cross_correlation_ratio", "ZDR": "differential_reflectivity", "WIDTH": "spectrum_width"}

SITES = "site_id string, lat double, lon double, elev_ft int, name string, timezone string"
SCAN_CATALOG = "site string, scan_date date, key string, filename string, ord int"
VOLUMES = "site string, scan_key string, scan_time timestamp, lat double, lon double, range_m array<double>"
RAYS = "site string, scan_key string, sweep_idx int, ray_idx int, azimuth_deg double, elevation_deg double, " + ", ".join(f"{f} array<float>" for f in FIELDS)
CELLS = "scan_key string, label int, cell_id string, az_deg double, range_km double, az_center_idx int, range_center_idx int, dbz_max double, n_gates int"
RESULT = "cell_id string, probability double, logit double, heatmap_row int, heatmap_col int, heatmap_rows int, heatmap_cols int, heatmap_edge_margin double, activation_az_deg double, activation_range_km double"
CANDIDATE = "struct<cand_idx:int,cell_id:string,probability:double,threshold:double,az_deg:double,range_km:double,activation_az_deg:double,activation_range_km:double,quality_pass:boolean,reasons:array<string>>"
SCANS = f"site string, scan_time timestamp, candidates array<{CANDIDATE}>"
OBSERVATION = "struct<scan_time:timestamp,cell_id:string,probability:double,above_threshold:boolean,x_km:double,y_km:double,activation_x_km:double,activation_y_km:double,quality_pass:boolean,quality_reasons:array<string>,missed:boolean>"
TRACKS = f"track_id string, site string, created_at timestamp, confirmed_at timestamp, observations array<{OBSERVATION}>"
UPDATES = "site string, scan_time timestamp, cand_idx int, cell_id string, track_id string, status string, hits_in_window int, window_size int, newly_confirmed boolean"
ATTEMPTS = "site string, seq long, status string, cells_found int, chips_processed int, raw_detections int, detections int"
SCHEDULE = "site string, seq long, status string, activity_score int, consecutive_quiet int, consecutive_no_new int, consecutive_errors int, delay_seconds int, priority int, reason string"
PLACES = "name string, lon double, lat double, pop_max long"
RESULTS_CSV = ("scan_time", "site", "cell_id", "az_deg", "range_km", "lat", "lon", "dbz_max", "n_gates", "probability", "above_threshold")

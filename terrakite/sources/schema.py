"""Schemas of the map data model.  Matrices are column-major arrays; times are BIGINT in the unit of their producer."""

FRAMES = "id BIGINT, timestamp BIGINT, intrinsics ARRAY<DOUBLE>, extrinsics ARRAY<DOUBLE>"
GPS = "timestamp BIGINT, relative ARRAY<DOUBLE>, global ARRAY<DOUBLE>, accuracy ARRAY<DOUBLE>"
BOUNDS = "STRUCT<lower: STRUCT<x: DOUBLE, y: DOUBLE>, upper: STRUCT<x: DOUBLE, y: DOUBLE>>"
LANDMARK_JSON = f"id BIGINT, desc STRING, position ARRAY<DOUBLE>, orientation ARRAY<FLOAT>, sightings INT, bounds {BOUNDS}"
ANCHOR_JSON = "frame_id BIGINT, transform ARRAY<DOUBLE>, relative_transform ARRAY<DOUBLE>"
MAP_JSON = f"origin_ready BOOLEAN, origin ARRAY<DOUBLE>, landmarks ARRAY<STRUCT<id: BIGINT, desc: STRING, position: ARRAY<DOUBLE>, orientation: ARRAY<FLOAT>, sightings: INT, bounds: {BOUNDS}>>, anchors ARRAY<ARRAY<STRING>>, edges ARRAY<ARRAY<STRING>>"
KEYPOINT = "STRUCT<x: FLOAT, y: FLOAT, size: FLOAT, angle: FLOAT, response: FLOAT, octave: INT>"
OBSERVATIONS = f"landmark_id BIGINT, frame_id BIGINT, timestamp BIGINT, cam_pose ARRAY<DOUBLE>, kpt {KEYPOINT}, depth FLOAT, depth_confidence FLOAT, surface_normal ARRAY<FLOAT>"
DESCRIPTOR_BYTES = 128

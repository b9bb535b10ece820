"""Constants that define semantics, and the engine's settings."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the analytics.
EARTH_KM, EARTH_MILES, EARTH_M = 6373.0, 3960.0, 6373000.0
STOP_RADIUS_KM, STOP_MINUTES = 0.02, 10
DEPOT_HOURS = 4.0
CITY_LAT, CITY_LON, CITY_RADIUS_KM = -33.469994, -70.642193, 60.0
CELL_METRES, DEGREE_METRES = 50, 100_000.0
SAMPLE_EVERY = 100
SPEED_CAP_MPS, HDOP_SOFT_CAP, FUTURE_DAYS, EPOCH_MS_FROM = 120.0, 10.0, 2, 1e10
ERROR_SAMPLE = 10


@dataclass(frozen=True)
class Settings:
    """What a deployment may switch; sources that are off warn and do nothing."""

    batch_size: int = 1000
    kafka_enabled: bool = False
    mqtt_enabled: bool = False
    kafka_servers: str = "localhost:9092"
    kafka_topic: str = "gps"
    mqtt_topic: str = "devices/+/gps"
    trigger: str = "10 seconds"
    #: How much runs at once: the streams' scheduler pool, files that one batch takes, and batches that a driver ingests.
    pool: str = "ingest"
    files_at_once: int = 1000
    jobs_at_once: int = 4

"""Schemas, constants and validated settings."""

from __future__ import annotations

from dataclasses import dataclass

# The band plan.
CHANNEL_1_HZ = 446_006_250.0
CHANNEL_SPACING_HZ = 12_500.0
CHANNEL_COUNT = 16
RECEIVER_CENTRE_HZ = 446_593_750.0
OCCUPIED_BANDWIDTH_HZ = 11_000.0
CHANNEL_TOLERANCE_HZ = 2_000.0

# Thresholds of attribution, grouping, scoring, identification and publishing.
PRODUCT_TOLERANCE_HZ = 2_000.0
LEVEL_MARGIN_DB = 10.0
EMITTER_TOLERANCE_HZ = 3_000.0
TONE_TOLERANCE_HZ = 1.0
SCORE_TOLERANCE_HZ = 6_250.0
FRIEND_TOLERANCE_HZ = 0.5
STALE_S = 300.0
UNKNOWN_ERROR_M = 9_999_999.0
SPEED_OF_LIGHT = 299_792_458.0
THERMAL_NOISE_DBM_PER_HZ = -174.0

# The 38 standard sub-audible tones in Hz.
TONES_HZ = (
    67.0, 71.9, 74.4, 77.0, 79.7, 82.5, 85.4, 88.5, 91.5, 94.8, 97.4, 100.0, 103.5, 107.2, 110.9, 114.8, 118.8, 123.0, 127.3,
    131.8, 136.5, 141.3, 146.2, 151.4, 156.7, 162.2, 167.9, 173.8, 179.9, 186.2, 192.8, 203.5, 210.7, 218.1, 225.7, 233.6, 241.8, 250.3,
)

# Antennas (name, lowest and highest frequency, claimed gain, largest dimension, measured gain).
ANTENNAS = (
    ("wideband 40-860 MHz", 40e6, 860e6, None, 1.0, None),
    ("wideband 40 MHz - 6 GHz", 40e6, 6e9, None, 0.5, None),
    ("panel 700-2700 MHz 35 dBi", 700e6, 2700e6, 35.0, 0.3, None),
    ("panel 700-2700 MHz 12 dBi", 700e6, 2700e6, 12.0, 0.25, None),
    ("8 dBi 2.4/5/5.8 GHz", 2400e6, 5900e6, 8.0, 0.2, None),
)

# The deployed receive chain (place, name, gain, noise figure, linear input limit).
CHAIN = (
    (1, "antenna cable", -0.5, 0.5, 30.0),
    (2, "external LNA", 20.0, 1.0, -10.0),
    (3, "LNA-to-SDR cable", -0.2, 0.2, 30.0),
    (4, "receiver", 0.0, 8.0, -5.0),
)

# Names and order of an emission's fields.
EMISSION_DDL = (
    "timestamp double, frequency_hz double, pmr_channel int, bin_index int, duration_s double, peak_power_dbfs double, snr_db double, "
    "estimated_dbm double, calibrated boolean, ctcss_tone_hz double, classification string, offset_s double, peak_deviation_hz double, "
    "gains struct<lna_db: double, vga_db: double, amp_enabled: boolean>, attributed_to_hz double, attribution string"
)
#: The flattened form at rest, in the store's column order.
STORE_COLUMNS = (
    "timestamp frequency_hz pmr_channel bin_index duration_s peak_power_dbfs snr_db estimated_dbm calibrated ctcss_tone_hz classification "
    "offset_s peak_deviation_hz lna_db vga_db amp_enabled attributed_to_hz attribution"
).split()
TRUTH_DDL = "emitter string, start_s double, stop_s double, frequency_hz double, pmr_channel int, ctcss_hz double, received_dbm double, snr_db double"
# The rasters of terrestrial television channels and of cellular carriers.
UHF_BASE_HZ, UHF_STEP_HZ, UHF_CHANNELS = 306e6, 8e6, (21, 48)
CARRIER_RASTER_HZ = 100e3

IQ_DDL = "capture_id string, block_idx bigint, start_sample bigint, n int, start_time double, iq array<float>"


@dataclass(frozen=True)
class Settings:
    """Receiver and detector settings, checked before any plan is built."""

    sample_rate: float = 2_000_000.0
    centre_hz: float = RECEIVER_CENTRE_HZ
    num_channels: int = 160
    decimation: int = 80
    taps_per_phase: int = 12
    pfa: float = 1e-8
    reference_cells: int = 24
    guard_cells: int = 2
    order_statistic: int = 18
    hold_frames: int = 64
    level_exclusion: float = 8.0
    hangover_frames: int = 6_250
    min_frames: int = 2_500
    max_frames: int = 500_000
    min_occupancy: float = 0.35
    dc_guard_bins: int = 1
    edge_guard_share: float = 0.05
    method: str = "os"

    def __post_init__(self):
        if self.num_channels < 2 or self.decimation < 1 or self.decimation > self.num_channels:
            raise ValueError("the decimation must lie between 1 and the number of channels")
        if not 0 < self.pfa < 1:
            raise ValueError("the false-alarm probability must lie inside 0 to 1")
        if self.reference_cells < 2 or self.reference_cells % 2 or not 1 <= self.order_statistic <= self.reference_cells:
            raise ValueError("reference cells must be even and hold the order statistic")
        if self.reference_cells + 2 * self.guard_cells + 1 > self.num_channels:
            raise ValueError("the detection window is wider than the spectrum")
        if self.method not in ("os", "ca"):
            raise ValueError("the method is os or ca")
        if self.min_frames < 1 or self.max_frames < self.min_frames or self.hangover_frames < 0 or not 0 <= self.min_occupancy <= 1:
            raise ValueError("inconsistent tracker limits")
        spacing = self.sample_rate / self.num_channels
        for k in range(CHANNEL_COUNT):
            if abs(CHANNEL_1_HZ + k * CHANNEL_SPACING_HZ - self.centre_hz) < spacing / 2:
                raise ValueError("a channel lies on the receiver's centre, where its own offset is")

    @property
    def frame_rate(self) -> float:
        return self.sample_rate / self.decimation

    @property
    def num_taps(self) -> int:
        return self.num_channels * self.taps_per_phase

    def excluded_bins(self) -> list[int]:
        """Bins around zero and around the band edge, which detection leaves out."""
        m, g, e = self.num_channels, self.dc_guard_bins, max(1, int(self.num_channels * self.edge_guard_share))
        return sorted({k for k in range(m) if k < g or (g > 1 and k > m - g) or (e and m // 2 - e <= k < m // 2 + e)})

"""Schemas of the base tables; filename is the key of a recording in each of them."""

from __future__ import annotations

CLIP = "filename string, duration double, fps double, fps_adjusted double"
VIDEO_ANNOTATION = (
    "filename string, frame bigint, time double, face_box array<double>, face_prob double, "
    "face_landmarks array<array<double>>, face_aus array<double>, face_label string, face_confidence double"
)
FACE_EMBEDDINGS = "filename string, pos bigint, embedding array<double>"
AVERAGE_EMBEDDINGS = "filename string, face_label string, embedding array<double>"
SEGMENTS = "filename string, channel int, begin double, end double, name string, conf double"
TRANSCRIPTION = "filename string, begin double, end double, index int, text string, speaker string, confidence double"
SENTIMENT = "filename string, begin double, end double, text string, pos double, neg double, neu double"
WORDS = "array<struct<start: double, end: double, probability: double>>"

VOICE_FEATURES = (
    "pitch_f0_hz", "jitter_local_rel_f0", "shimmer_local_rel_f0", "hnr_db",
    "f1_freq_hz", "f1_bandwidth_hz", "f1_amplitude_rel_f0",
    "f2_freq_hz", "f2_bandwidth_hz", "f2_amplitude_rel_f0",
    "f3_freq_hz", "f3_bandwidth_hz", "f3_amplitude_rel_f0",
    "alpha_ratio_db", "hammar_index_db", "spectral_slope_0_500", "spectral_slope_500_1500",
    "h1_h2_diff_db", "h1_f3_diff_db", "mfcc_1", "mfcc_2", "mfcc_3", "mfcc_4", "spectral_flux", "rms_db",
)

#: Order of columns in the merged table; those of inputs that are absent are left out.
MERGED = (
    "filename", "time", "frame", "face_box", "face_prob", "face_landmarks", "face_aus", "face_label", "face_confidence",
    "segment_start", "segment_end", "segment_speaker_label", "span_start", "span_end", "span_text", "span_confidence",
    "span_sent_pos", "span_sent_neg", "span_sent_neu",
)

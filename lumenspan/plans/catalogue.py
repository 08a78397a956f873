"""The operators under the names that analyses call them by, with inputs, outputs and parameter defaults.

Networks are not part of the library: where one is needed, its raw output (or
embedding) is an input, and `infer` runs whatever model the caller brings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audio, similarity, timejoin, windows
from ..operators import boxes as _boxes
from ..operators import frames as _frames
from ..operators import series as _series
from ..operators import shots as _shots
from ..sources import ingest
from .registry import operator

_SERIES = {"series": "series"}


def register(name, requires, provides, call, parameters=None, optional=()):
    operator(name, requires, provides, parameters, optional=optional)(call)

# series
register("aggregate_scalar", _SERIES, _SERIES, lambda series, aggregation: _series.aggregate_scalar(series, aggregation), {"aggregation": "prod"})
register("aggregate_scalar_per_time", _SERIES, _SERIES, lambda series, aggregation: _series.aggregate_per_time(series, aggregation, ("media_id",)), {"aggregation": "or"})
register("aggregate_list_scalar_per_time", _SERIES, _SERIES, lambda series, aggregation: _series.aggregate_per_time(series, aggregation), {"aggregation": "or"})
register("scalar_threshold", _SERIES, _SERIES, lambda series, min, max: _series.scalar_threshold(series, min, max), {"min": None, "max": None})
register("invert_scalar", _SERIES, _SERIES, lambda series: _series.invert_scalar(series))
register("min_max_norm", _SERIES, _SERIES, lambda series, eps: _series.min_max_norm(series, eps), {"eps": 0.01})

# shots
_SHOTS = {"shots": "shots"}
register("shot_annotator", {**_SHOTS, "probs": "series"}, {"annotations": "annotations"}, lambda shots, probs, threshold: _shots.shot_annotator(shots, probs, threshold), {"threshold": 0.0})
register("shot_scalar_annotator", {**_SHOTS, "series": "series"}, {"annotations": "annotations"}, lambda shots, series, width: _shots.shot_scalar_annotator(shots, series, width), {"width": None})
register("shot_density", _SHOTS, _SERIES, lambda shots, kernel, bandwidth, fps: _shots.shot_density(shots, kernel, bandwidth, fps), {"kernel": "gaussian", "bandwidth": 30.0, "fps": 10.0})
register("blip_vqa", {**_SHOTS, "texts": ""}, {"annotations": "annotations"}, lambda shots, texts: _shots.shot_texts(shots, texts))
register("transnet_shotdetection", {"scores": ""}, _SHOTS, lambda scores, threshold, fps: _shots.shots_from_scores(scores, threshold, fps), {"threshold": 0.5, "fps": 25.0})
register("timeline_video_sampler", {**_SHOTS, "frames": "frames"}, {"frames": ""}, lambda shots, frames, middle, start, end, mode: timejoin.timeline_sampler(shots, frames, middle, start, end, mode), {"middle": True, "start": False, "end": False, "mode": "nearest"})
register("insightface_facesize", {**_SHOTS, "labels": "", "boxes": ""}, {"annotations": "annotations", "facesizes": "series"}, lambda shots, labels, boxes, reduction: {"annotations": _shots.face_shot_labels(shots, labels, boxes), "facesizes": _shots.facesize(boxes, reduction)}, {"reduction": "max"})

# embeddings and clusters
_EMB = {"embeddings": "embeddings"}
_CLUSTERS = {"clusters": "clusters"}


def _clusters(embeddings, t, metric, max_samples):
    return similarity.build_clusters(similarity.cluster_labels(embeddings, t, metric), embeddings, max_samples)


register("clustering", _EMB, _CLUSTERS, lambda embeddings, t, max_samples: _clusters(embeddings, t, "cosine", max_samples), {"t": 0.5, "max_samples": 30})
register("dbscanclustering", _EMB, _CLUSTERS, _clusters, {"t": 0.5, "metric": "cosine", "max_samples": 30})
register("place_clustering", {**_EMB, "places": ""}, _CLUSTERS, lambda embeddings, places, t, max_samples: similarity.place_clusters(embeddings, places, t, max_samples), {"t": 0.25, "max_samples": 30})
register("cluster_size_filter", {"clusters": ""}, _CLUSTERS, lambda clusters, max_cluster: similarity.top_clusters(clusters, max_cluster), {"max_cluster": 50})
register("cosine_similarity", {"query": "", "target": ""}, _SERIES, lambda query, target, normalize, lo, hi: similarity.cosine_similarity(query, target, normalize, lo, hi), {"normalize": False, "lo": None, "hi": None})
for _name in ("clip_probs", "x_clip_probs"):
    register(_name, {"images": "", "positive": "", "negative": ""}, _SERIES, lambda images, positive, negative, softmax: similarity.text_image_probs(images, positive, negative, softmax), {"softmax": False})
register("clip_ontology_probs", {**_EMB, "concepts": ""}, _SERIES, lambda embeddings, concepts: similarity.ontology_probs(embeddings, concepts))
register("places_classifier", {"probs": "", "hierarchy": ""}, {"places": "places"}, lambda probs, hierarchy: similarity.places_rollup(probs, hierarchy))

# boxes
_BOXES = {"boxes": "boxes"}
register("face_size_filter", {**_BOXES, "faces": "faces", "images": "", "keypoints": ""}, {**_BOXES, "faces": "faces", "images": "", "keypoints": ""}, lambda boxes, faces, min_face_height, images=None, keypoints=None: _boxes.face_size_filter(boxes, faces, images, keypoints, min_face_height), {"min_face_height": 0.1}, optional=("images", "keypoints"))


def _detect(raw, det_thresh, nms_thresh):
    """Raw detections (width, height, stride, anchor_idx, distances, det_score, media_id, frame_idx, id) to boxes that are left."""
    corners = _boxes.decode_boxes(_boxes.filter_detections(raw, det_thresh))
    sized = corners.withColumns({"x": F.col("x1"), "y": F.col("y1"), "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})
    return _boxes.nms(sized, nms_thresh)


for _name in ("insightface_video_detector_torch", "insightface_image_detector_torch"):
    register(_name, {"raw": ""}, _BOXES, _detect, {"det_thresh": 0.5, "nms_thresh": 0.4})
register("ocr_video_detector_onnx", {"words": ""}, {"lines": ""}, lambda words, nms_thresh: _boxes.merge_lines(_boxes.nms(words, nms_thresh, extra=("text",))), {"nms_thresh": 0.4})
register("insightface_video_feature_extractor", {"frames": "frames", "keypoints": ""}, {"crops": ""}, lambda frames, keypoints: timejoin.frames_at(frames, keypoints))
register("insightface_video_gender_age_calculator", {"frames": "frames", "boxes": ""}, {"crops": ""}, lambda frames, boxes: _boxes.crop_geometry(timejoin.frames_at(frames, boxes)))
register("insightface_image_feature_extractor", {"images": "", "faces": "faces", "keypoints": ""}, {"crops": ""}, lambda images, faces, keypoints: timejoin.face_crops(images, faces, keypoints))
register("deepface_emotion", {"images": "", "scores": ""}, _SERIES, lambda images, scores: timejoin.resolve_refs(scores, images))

# frames, audio, text
register("color_brightness_analyser", {"pixels": ""}, _SERIES, lambda pixels, fps, normalize: _frames.brightness(pixels, fps, normalize), {"fps": 5.0, "normalize": True})
register("color_analyser", {"pixels": ""}, {"colors": "colors"}, lambda pixels, k, fps, max_iter: _frames.dominant_colors(pixels, k, fps, max_iter), {"k": 1, "fps": 5.0, "max_iter": 10})
register("thumbnail_generator", {"frames": "frames"}, {"frames": ""}, lambda frames, fps, max_dim: _frames.scaled_size(windows.resample_frames(frames, fps), max_dim), {"fps": 5.0, "max_dim": 128})
register("audio_amp_analysis", {"samples": ""}, _SERIES, lambda samples, sr, max_samples, normalize: audio.audio_amp(samples, sr, max_samples, normalize), {"sr": 8000, "max_samples": 200_000, "normalize": True})
register("audio_rms_analysis", {"samples": ""}, _SERIES, lambda samples, sr, hop, frame, normalize: audio.audio_rms(samples, sr, hop, frame, normalize), {"sr": 8000, "hop": 512, "frame": 2048, "normalize": True})
register("audio_freq_analysis", {"samples": ""}, {"hist": "hist"}, lambda samples, sr, n_fft, normalize: audio.audio_freq(samples, sr, n_fft, None, normalize), {"sr": 8000, "n_fft": 256, "normalize": True})
register("whisper", {"segments": "", "media": ""}, {"annotations": "annotations"}, lambda segments, media: ingest.fill_segments(segments, media))
register("x_clip_video_embedding", {"frames": "frames"}, {"batches": ""}, lambda frames, fps, batch: windows.frame_batches(frames, batch, fps), {"fps": 2.0, "batch": 8})
register("x_clip_text_embedding", {"texts": ""}, {"texts": ""}, lambda texts: texts.withColumn("text", X.clean_text(F.col("text"))))


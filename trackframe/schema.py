"""Types of the data model: skeletons, clips, segments, detections, and their fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA_VERSION = "1.0.0"

# The skeleton, the motion types and the sizes of vectors that files and models share.
JOINT_NAMES = (
    "Hips", "Spine", "Spine1", "Spine2", "Neck", "Head",
    "LeftShoulder", "LeftArm", "LeftForeArm", "LeftHand",
    "RightShoulder", "RightArm", "RightForeArm", "RightHand",
    "LeftUpLeg", "LeftLeg", "LeftFoot", "LeftToeBase",
    "RightUpLeg", "RightLeg", "RightFoot", "RightToeBase",
)
JOINT_PARENT = (-1, 0, 1, 2, 3, 4, 3, 6, 7, 8, 3, 10, 11, 12, 0, 14, 15, 16, 0, 18, 19, 20)
REST_OFFSETS = (
    (0, 0, 0), (0, 10, 0), (0, 10, 0), (0, 10, 0), (0, 8, 0), (0, 8, 0),
    (-5, 0, 0), (-8, 0, 0), (-25, 0, 0), (-23, 0, 0),
    (5, 0, 0), (8, 0, 0), (25, 0, 0), (23, 0, 0),
    (-9, -3, 0), (0, -40, 0), (0, -38, 0), (0, -3, 8),
    (9, -3, 0), (0, -40, 0), (0, -38, 0), (0, -3, 8),
)
MOTION_TYPES = (
    "Idle", "Walk", "Jog", "Sprint", "TurnLeft", "TurnRight", "Decelerate", "Jump",
    "Slide", "Kick", "Tackle", "Shield", "Receive", "Celebrate", "Goalkeeper", "Unknown",
)
COCO_NAMES = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow",
    "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle",
    "right_ankle",
)
OKS_SIGMAS = (
    0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089,
)
JOINT_COUNT, COCO_COUNT, STYLE_DIM, EMBEDDING_DIM, REID_DIM = 22, 17, 64, 128, 128
SPRINT_SPEED, MAX_TURN_RATE = 800.0, 360.0  # features are divided by these

JOINT = {name: k for k, name in enumerate(JOINT_NAMES)}
COCO = {name: k for k, name in enumerate(COCO_NAMES)}
MOTION = {name: k for k, name in enumerate(MOTION_TYPES)}
#: Joint that stands where each joint does once left and right are exchanged.
MIRRORED = tuple(
    JOINT[n.replace("Left", "Right") if n.startswith("Left") else n.replace("Right", "Left")] for n in JOINT_NAMES
)


def _struct(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


VEC2, VEC3, QUAT = _struct("xy"), _struct("xyz"), _struct("wxyz")
ROT6D = T.ArrayType(T.DoubleType())
BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "w", "h", "conf")])
JOINT_STATE = (
    T.StructType().add("rot", QUAT).add("euler", VEC3).add("rot6d", ROT6D).add("pos", VEC3).add("conf", T.DoubleType())
)
FRAMES = (
    T.StructType()
    .add("track_id", T.IntegerType())
    .add("frame_idx", T.IntegerType())
    .add("ts", T.DoubleType())
    .add("root_pos", VEC3)
    .add("root_rot", QUAT)
    .add("root_vel", VEC3)
    .add("root_ang_vel", VEC3)
    .add("joints", T.ArrayType(JOINT_STATE))
)
SEGMENTS = (
    T.StructType()
    .add("track_id", T.IntegerType())
    .add("seg_idx", T.IntegerType())
    .add("type", T.IntegerType())
    .add("start_frame", T.IntegerType())
    .add("end_frame", T.IntegerType())
    .add("avg_velocity", T.DoubleType())
    .add("avg_direction", VEC3)
    .add("confidence", T.DoubleType())
)
PERSONS = (
    T.StructType()
    .add("video", T.StringType())
    .add("frame_idx", T.IntegerType())
    .add("ts", T.DoubleType())
    .add("person_id", T.IntegerType())
    .add("class_label", T.StringType())
    .add("bbox", BBOX)
    .add("kp2d", T.ArrayType(T.StructType().add("x", T.DoubleType()).add("y", T.DoubleType()).add("conf", T.DoubleType())))
    .add("kp3d", T.ArrayType(_struct("xyz").add("conf", T.DoubleType())))
    .add("reid", T.ArrayType(T.DoubleType()))
)
STYLE_SCALARS = (
    "stride_length_scale", "arm_swing_intensity", "sprint_lean_angle", "hip_rotation_scale",
    "knee_lift_scale", "cadence_scale", "deceleration_sharpness", "turn_lead_body",
)


def motion_types(spark: SparkSession) -> DataFrame:
    """The 16 motion types as a dimension: code, name."""
    return spark.createDataFrame(list(enumerate(MOTION_TYPES)), "code int, name string")


def joints(spark: SparkSession) -> DataFrame:
    """The skeleton as a dimension: code, name, parent (null at the root), rest offset."""
    rows = [(k, n, None if p < 0 else p, tuple(map(float, o))) for k, (n, p, o) in enumerate(zip(JOINT_NAMES, JOINT_PARENT, REST_OFFSETS))]
    return spark.createDataFrame(rows, T.StructType().add("code", T.IntegerType()).add("name", T.StringType()).add("parent", T.IntegerType()).add("offset", VEC3))

#: Left and right key points of COCO, as places.
COCO_PAIRS = ((1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (15, 16))

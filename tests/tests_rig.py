"""A small rig: hips, spine with a tip, two feet with tips; mixed Euler orders."""

import numpy as np


def rig(frames=6, step=1 / 30, seed=0):
    r = np.random.default_rng(seed)
    return {
        "frame_time": step, "n_frames": frames, "names": ["Hips", "Spine", "Spine_end", "LeftFoot", "LeftFoot_end", "RightFoot", "RightFoot_end"],
        "parents": [-1, 0, 1, 0, 3, 0, 5], "joint_idx": [0, 1, -1, 2, -1, 3, -1], "offsets": [[0, 0, 0], [0, 4, 0], [0, 2, 0], [1, -4, 0], [0, -1, 1], [-1, -4, 0], [0, -1, 1]],
        "euler_orders": ["ZXY", "XYZ", "ZYX", "YXZ"], "root": r.normal(size=(frames, 3)).tolist(), "joints": r.uniform(-1, 1, size=(frames, 4, 3)).tolist(),
    }

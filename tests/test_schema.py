import pytest

from kinetra import schema as S


def test_descriptors():
    flat = S.describe_flat(24, "6d", streams=["root_pos", "joint_rot", "joint_vel"])
    assert flat["root_pos"] == (0, 3) and flat["joint_vel"] == (147, 219) and flat.total_dim == 219
    assert "joint_rot" in flat and "node_pos" not in flat and flat.slice("joint_rot") == slice(3, 147)
    graph = S.describe_graph(24, "quat")
    assert graph.shape(10, "ctv") == (4, 10, 25) and graph.shape(10, "tvc") == (10, 25, 4)
    assert S.describe_graph(5, streams=["root_pos"]).shape(2) == (3, 2, 1)
    with pytest.raises(ValueError):
        graph.shape(1, "flat")
    with pytest.raises(ValueError):
        S.describe_flat(3, streams=["node_pos"])


@pytest.mark.parametrize("streams", [[], ["nope"], ["root_pos", "root_pos"], ["joint_pos", "node_pos"], ["joint_rot", "node_vel"]])
def test_bad_streams(streams):
    with pytest.raises(ValueError):
        S.check_streams(streams)
    with pytest.raises(ValueError):
        S.describe_flat(3, streams=streams, num_nodes=4)


def test_stream_conditions():
    with pytest.raises(ValueError):
        S.check_streams(["joint_rot"], ["root_pos"])
    with pytest.raises(ValueError):
        S.check_streams(["joint_vel"], ["joint_pos"], None)
    S.check_streams(["root_pos", "joint_vel"], ["root_pos", "joint_pos"], "world")
    assert S.channel_count(True, [1]) == 3 and S.channel_count(False, [1]) == 1


@pytest.mark.parametrize("token,want", [("+x", (0, 1)), ("-z", (2, -1))])
def test_axis(token, want):
    assert S.parse_axis(token) == want


@pytest.mark.parametrize("f,bad", [(S.parse_axis, "y"), (S.parse_axis, "+w"), (S.check_euler_order, "XXY"), (S.check_probability, 1.5), (S.check_sigma, -1), (S.check_drop_rate, 1.0), (S.check_factor, 0), (S.require_representation, "matrix"), (S.require_centering, "hips"), (S.check_root_channels, 0)])
def test_refusals(f, bad):
    with pytest.raises(ValueError):
        f(bad)

"""Physical shapes shared by the operators, and the fitted-sequence and graph runners."""
